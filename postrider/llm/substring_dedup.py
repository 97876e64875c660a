"""Repeated passages by prefix-partitioned suffix trees over words.

A suffix is a word position with ``width`` words from there on.  Each is filed under
its anchor: of the short word sequences within its ``width`` words, the one of least
hash.  Equal suffixes have equal anchors, and neighbours mostly share one, so a run
of them travels as one stretch, some three times the text in all instead of
``width`` times; frequent words are written as numbers of one to three bytes.
The anchors' own suffixes are split by prefixes of variable length: one word where
few stretches have it, else two, and so on, and the whole suffix where even the
longest prefix is too many.  Prefixes are dealt to memory-sized groups.

A group's tree is built from the root down, level by level, and only where a node has
two leaves or more: each level sorts the leaves of the open nodes by their next
words and closes those that stand alone.  What is left at depth ``width`` are the
internal nodes of that depth; the suffixes below one have all those words in
common, and all but those of the smallest document are repeats.  Consecutive
repeats make the maximal repeated passages.  Words are numbered by their bytes, so
no repeat rests on hashes.

Each block of documents builds such a tree first and sends only the suffixes of its
smallest document on; the others are known repeats.  Prefixes that remain too large
are combined in salted groups before their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NON_SPACE, Block, Words, blocks, checkpointed, covered, mix64, window_hashes, word_hashes, word_numbers, words_of

WIDTH = 13
#: Stretches in a group, about.
GROUP_ROWS = 40_000
#: Bytes of text in one task of the last step, about.
PART_BYTES = 32 << 20
#: Most words that are written as numbers.
ALPHABET = 300_000
SALTS = 16
#: Most cells of a level that a plan names.
NAMED_CELLS = 1 << 20
_BLOCK = 4 << 20
# Numbers that take one, two and three bytes.
_ONE, _TWO, _THREE = 95, 128 * 95, 128 * 128 * 95
_ROW = "grp long, id long, place long, n int, words binary"


def deep_nodes(words: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(leaves, node): the suffixes of ``at`` that lie below an internal node at ``depth`` words, as indexes of ``at``, and the number of that node.

    ``words`` are word numbers; nodes are opened from the root down, several words a level.
    """
    leaves, node = np.arange(len(at)), np.zeros(len(at), np.int64)
    bits = max(1, int(words.max(initial=1)).bit_length())
    done = 0
    while done < depth and len(leaves):
        take = min(depth - done, max(1, (63 - int(node[-1]).bit_length()) // bits))
        key = node
        for k in range(take):
            key = key << bits | words[at[leaves] + done + k]
        order = np.argsort(key)
        key = key[order]
        head = np.concatenate([[True], key[1:] != key[:-1]])
        alone = head & np.append(head[1:], True)
        leaves, node = leaves[order[~alone]], np.cumsum(head[~alone]) - 1
        done += take
    return leaves, node


def repeats(words: np.ndarray, at: np.ndarray, ids: np.ndarray, depth: int) -> np.ndarray:
    """Whether each suffix lies below a deep node that also has a suffix of a smaller id."""
    leaves, node = deep_nodes(words, at, depth)
    out = np.zeros(len(at), dtype=bool)
    if len(leaves):
        least = np.minimum.reduceat(ids[leaves], np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])))
        out[leaves] = ids[leaves] > least[node]
    return out


def _suffixes(block: Block, width: int):
    """(word starts, lengths, first word of each text, word hashes, suffix positions, text of each suffix)."""
    starts, lengths, firsts = words_of(block, NON_SPACE)
    n = np.maximum(np.diff(firsts) - width + 1, 0)
    text = np.repeat(np.arange(len(block)), n)
    at = firsts[:-1][text] + np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    return starts, lengths, firsts, word_hashes(block, starts, lengths), at, text


def anchors(h: np.ndarray, at: np.ndarray, width: int, length: int) -> np.ndarray:
    """Position of each suffix's anchor: the first run of ``length`` words of least hash within its ``width`` words."""
    run = window_hashes(h, length)
    least, out = (run[at], at.copy()) if len(at) else (np.zeros(0, np.uint64), at)
    for k in range(1, width - length + 1):
        value = run[at + k]
        less = value < least
        least[less] = value[less]
        out[less] = at[less] + k
    return out


def anchor_words(n_words: int) -> int:
    """Words of the longest prefix: three, and one more for each hundredfold from 10^11 words on."""
    return 3 + sum(n_words > 10**k for k in (11, 13, 15))


def _run_heads(*columns: np.ndarray) -> np.ndarray:
    """Indexes at which any column differs from the row before; a column that steps by one is given less its index."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    change = np.zeros(len(columns[0]), dtype=bool)
    change[0] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def _prefixes(h: np.ndarray, at: np.ndarray, length: int) -> list[np.ndarray]:
    """Hashes of the prefixes of one to ``length`` words at ``at``."""
    return [mix64(h[at]) if k == 1 else window_hashes(h, k)[at] for k in range(1, length + 1)]


def _summed(cells: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different cells in order, and the sums of their counts."""
    cells, counts = np.concatenate([np.zeros(0, np.int64), *cells]), np.concatenate([np.zeros(0, np.int64), *counts])
    order = np.argsort(cells, kind="stable")
    cells = cells[order]
    head = _run_heads(cells)
    return cells[head], np.add.reduceat(counts[order], head) if len(head) else counts


def survey(docs: DataFrame, width: int, length: int, bits: int, most: int = ALPHABET) -> DataFrame:
    """(level, cell, word, n): different stretches of each block under each hashed prefix of one to ``length`` words, and words that recur in a task, its ``most`` / 2 most frequent ones at most.

    Which words these are changes sizes only, never results.  A task holds the cells
    of its own texts, however many cells there are.
    """

    def rows(level, cell, word, n) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(level, pa.int32()), pa.array(cell, pa.int64()), word, pa.array(n, pa.int64())], names=["level", "cell", "word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen, compact = ([], []), {}, 1 << 21
        for batch in batches:
            for block in blocks(batch.column(0), limit=_BLOCK):
                starts, lengths, _, h, at, text = _suffixes(block, width)
                a = anchors(h, at, width, length)
                head = _run_heads(a, text)
                n = np.diff(np.append(head, len(at))).astype(np.uint64)
                _, one = np.unique(window_hashes(h, width)[at[head]] + n, return_index=True)
                for level, value in enumerate(_prefixes(h, a[head[one]], length)):
                    held[0].append((value >> np.uint64(64 - bits)).astype(np.int64) + (level << bits))
                    held[1].append(np.ones(len(value), np.int64))
                if sum(map(len, held[0])) > compact:
                    held = tuple([x] for x in _summed(*held))
                    compact = max(compact, 2 * len(held[0][0]))
                order = np.argsort(h)
                head = _run_heads(h[order])
                n = np.diff(np.append(head, len(h)))
                again = np.flatnonzero(n > 1)
                for i, k in zip(order[head[again]].tolist(), n[again].tolist()):
                    word = block.raw[starts[i] : starts[i] + lengths[i]]
                    seen[word] = seen.get(word, 0) + k
            if len(seen) > most:
                seen = dict(sorted(seen.items(), key=lambda x: -x[1])[: most // 2])
        cell, n = _summed(*held)
        yield rows(cell >> bits, cell & ((1 << bits) - 1), pa.nulls(len(cell), pa.string()), n)
        top = sorted(((n, w) for w, n in seen.items() if len(w) <= 64), reverse=True)[: most // 2]
        yield rows(np.full(len(top), -1), np.zeros(len(top)), pa.array([w for _, w in top], pa.binary()).cast(pa.string()), [n for n, _ in top])

    return docs.select("text").mapInArrow(count, "level int, cell long, word string, n long").groupBy("level", "cell", "word").agg(F.sum("n").alias("n"))


class Plan:
    """How prefixes are extended and dealt, and how words are written.

    ``heavy`` names in order, for each level, the cells with more stretches than a
    group takes: there the prefix is extended, and at the last level split by the whole
    suffix.  A level with more than ``NAMED_CELLS`` of them is None and extends every
    prefix; the last level then names its largest, so that no other has more than that
    share of all stretches.  So a plan's size is bounded, whatever the texts.
    """

    def __init__(self, survey: DataFrame, length: int, bits: int, group_rows: int, most: int = ALPHABET):
        self.length, self.bits = length, bits
        survey = checkpointed(survey)
        counts, words = survey.filter("level >= 0"), survey.filter("level < 0").orderBy(F.desc("n"), "word").limit(most)
        rows = counts.filter("level = 0").agg(F.sum("n")).first()[0] or 0
        self.groups = max(1, -(-rows // group_rows))
        self.heavy: list[np.ndarray | None] = []
        over = counts.filter(F.col("n") > group_rows)
        for level in range(length):
            found = over.filter(F.col("level") == level).orderBy(F.desc("n"), "cell").select("cell", "n").limit(NAMED_CELLS + 1).toArrow()
            cells, n = (found.column(c).to_numpy()[:NAMED_CELLS] for c in ("cell", "n"))
            self.heavy.append(np.sort(cells) if len(found) <= NAMED_CELLS or level == length - 1 else None)
        self.whole = int((-(-n // group_rows)).sum())
        self.words = Words(words.select("word").toArrow().column(0).cast(pa.binary()).to_pylist())
        self.codes, self.code_edges = codes(len(self.words))

    def deal(self, h: np.ndarray, at: np.ndarray, a: np.ndarray, ids: np.ndarray, width: int) -> np.ndarray:
        """Group of each suffix by its anchor; those of too many equal prefixes go to salted groups, numbered from ``groups`` on."""
        levels = _prefixes(h, a, self.length)
        value, extend = levels[0].copy(), np.ones(len(a), dtype=bool)
        for k, own in enumerate(levels):
            value[extend] = own[extend]
            heavy = self.heavy[k]
            if heavy is not None:
                cell = (own >> np.uint64(64 - self.bits)).astype(np.int64)
                extend &= heavy[np.minimum(np.searchsorted(heavy, cell), len(heavy) - 1)] == cell if len(heavy) else False
        group = (value % np.uint64(self.groups)).astype(np.int64)
        if extend.any():
            whole = window_hashes(h, width)[at[extend]] % np.uint64(self.whole)
            group[extend] = self.groups + whole.astype(np.int64) * SALTS + ids[extend] % SALTS
        return group


def codes(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the numbers below n: bytes from 0x80 on, which go on, then one of 0x21..0x7F, which ends; no space among them."""
    i = np.arange(n)
    size = 1 + (i >= _ONE) + (i >= _ONE + _TWO)
    edges = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(int(edges[-1]), np.uint8)
    rest = i - np.where(size > 1, _ONE, 0) - np.where(size > 2, _TWO, 0)
    out[edges[1:] - 1] = 0x21 + rest % _ONE
    out[edges[:-1][size > 1]] = 0x80 + (rest // _ONE)[size > 1] % 128
    out[edges[:-1][size > 2] + 1] = 0x80 + (rest // (_ONE * 128))[size > 2]
    return out, edges


def _written(block: Block, starts: np.ndarray, lengths: np.ndarray, h: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): each word as its number, or spelled out between two spaces."""
    own = plan.words.find(block, starts, lengths, h)
    plain = own < 0
    size = np.where(plain, lengths + 2, np.diff(plan.code_edges, append=0)[own])
    low = np.where(plain, len(plan.codes) + starts - 1, plan.code_edges[own])
    offsets = np.concatenate([[0], np.cumsum(size)])
    data = np.concatenate([plan.codes, block.buf])[np.repeat(low - offsets[:-1], size) + np.arange(offsets[-1])]
    data[offsets[:-1][plain]] = data[offsets[1:][plain] - 1] = 0x20
    return data, offsets


def _tokens(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, number) of each word of written texts; number -1 means spelled out."""
    raw = block.buf[: block.size]
    space = raw == 0x20
    odd = np.cumsum(space) % 2 == 1
    inside = ~odd & ~space
    start = inside.copy()
    start[1:] &= ~(inside & (raw >= 0x80))[:-1]
    start[1:] |= (space & odd)[:-1]
    at = np.flatnonzero(start)
    a, b, c = (block.buf[at + k].astype(np.int64) for k in range(3))
    number = np.where(a < 0x80, a - 0x21, np.where(b < 0x80, _ONE + (a - 0x80) * _ONE + b - 0x21, _ONE + _TWO + ((b - 0x80) * 128 + a - 0x80) * _ONE + c - 0x21))
    length = 1 + (a >= 0x80).astype(np.int64) + ((a >= 0x80) & (b >= 0x80))
    spelled = ~inside[at]
    number[spelled] = -1
    length[spelled] = np.flatnonzero(space & ~odd) - at[spelled]
    return at, length, number


def _read(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word numbers, first word of each stretch) of written stretches; spelled words are numbered after the others."""
    if not len(column):
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    block = next(blocks(column.cast(pa.large_binary()).view(pa.large_string()), limit=1 << 62))
    at, length, number = _tokens(block)
    spelled = number < 0
    begin, size = at[spelled], length[spelled]
    number[spelled] = _ONE + _TWO + _THREE + word_numbers(block, begin, size, word_hashes(block, begin, size))
    return number, np.searchsorted(at, block.offsets)


def _batch(grp, ids, place, n, words) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(grp, pa.int64()), pa.array(ids, pa.int64()), pa.array(place, pa.int64()), pa.array(n, pa.int32()), words], names=["grp", "id", "place", "n", "words"])


def _known(grp, ids, place, n) -> pa.RecordBatch:
    return _batch(grp, ids, place, n, pa.nulls(len(ids), pa.binary()))


def _block_rows(ids: np.ndarray, txt: np.ndarray, block: Block, width: int, plan: Plan) -> Iterator[pa.RecordBatch]:
    """Rows of one block: known repeats (n, no words), and stretches of the suffixes that are to be compared with other blocks' (words, no n)."""
    starts, lengths, firsts, h, at, text = _suffixes(block, width)
    if not len(at):
        return
    number = word_numbers(block, starts, lengths, h)
    again = repeats(number, at, ids[text], width)
    place = (txt << 32)[text] + (at - firsts[text])
    hit = np.flatnonzero(again)
    head = hit[_run_heads(at[hit] - np.arange(len(hit)), text[hit])]
    if len(head):
        n = np.diff(np.append(np.searchsorted(hit, head), len(hit)))
        yield _known(ids[text[head]] % plan.groups, ids[text[head]], place[head], n)
    ask = np.flatnonzero(~again)
    at, text, place = at[ask], text[ask], place[ask]
    a = anchors(h, at, width, plan.length)
    group = plan.deal(h, at, a, ids[text], width)
    head = _run_heads(at - np.arange(len(at)), text, group)
    last = at[np.append(head[1:], len(at)) - 1] + width
    data, offsets = _written(block, starts, lengths, h, plan)
    for k in range(0, len(head), 200_000):
        one, end = head[k : k + 200_000], last[k : k + 200_000]
        low, size = offsets[at[one]], offsets[end] - offsets[at[one]]
        edges = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        part = data[np.repeat(low - edges[:-1], size) + np.arange(edges[-1])]
        words = pa.BinaryArray.from_buffers(pa.binary(), len(one), [None, pa.py_buffer(edges), pa.py_buffer(part)])
        yield _batch(group[one], ids[text[one]], place[one], pa.nulls(len(one), pa.int32()), words)


def stretches(docs: DataFrame, width: int, plan: Plan) -> DataFrame:
    """Known repeats and stretches (see ``_ROW``) of (id, txt, text) without nulls; place is txt and, in its low half, the first word."""
    shared = docs.sparkSession.sparkContext.broadcast(plan)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, txt = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)
            for block in blocks(batch.column(2), limit=_BLOCK):
                own = slice(block.first, block.first + len(block))
                yield from _block_rows(ids[own], txt[own], block, width, shared.value)

    return docs.select("id", "txt", "text").mapInArrow(emit, _ROW)


def group_tree(table: pa.Table, width: int) -> tuple[pa.Table, pa.Table]:
    """Repeats among a group's stretches together with those known before (no words), and the stretches with a suffix that is none."""
    asked, known = table.filter(table.column("words").is_valid()), table.filter(table.column("words").is_null())
    number, firsts = _read(asked.column("words").combine_chunks())
    n = np.maximum(np.diff(firsts) - width + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    at = firsts[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    ids, place, grp = (asked.column(c).to_numpy() for c in ("id", "place", "grp"))
    again = repeats(number, at, ids[row], width)
    hit = np.flatnonzero(again)
    head = _run_heads(at[hit] - np.arange(len(hit)), row[hit])
    own = row[hit[head]]
    found = _known(grp[own], ids[own], place[own] + at[hit[head]] - firsts[own], np.diff(np.append(head, len(hit))))
    some = np.bincount(row[~again], minlength=len(n)) > 0
    return pa.concat_tables([known, pa.Table.from_batches([found]).cast(table.schema)]), asked.filter(pa.array(some))


def repeat_runs(rows: DataFrame, width: int, plan: Plan) -> DataFrame:
    """(id, place, n): runs of ``n`` consecutive suffixes that repeat a smaller document's."""
    groups = plan.groups

    def tree(table: pa.Table) -> pa.Table:
        found, left = group_tree(table, width)
        salted = table.column("grp")[0].as_py() >= groups
        if not salted or not len(left):
            return found
        grp = pa.array(-1 - (left.column("grp").to_numpy() - groups) // SALTS)
        return pa.concat_tables([found, left.set_column(0, table.schema.field(0), grp)])

    n_tasks = max(1, min(100_000, groups // 2), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = rows.repartition(n_tasks, "grp").groupBy("grp").applyInArrow(tree, _ROW)
    if plan.whole:
        found = checkpointed(found)
        rest = found.filter("words IS NOT NULL").repartition(n_tasks, "grp").groupBy("grp").applyInArrow(tree, _ROW)
        found = found.filter("words IS NULL").unionByName(rest)
    return found.select("id", "place", "n")


def _write_texts(batch: pa.RecordBatch, plan: Plan) -> Iterator[pa.RecordBatch]:
    """(id, txt, words): whole texts as words, written like stretches."""
    for block in blocks(batch.column(2)):
        starts, lengths, firsts = words_of(block, NON_SPACE)
        data, offsets = _written(block, starts, lengths, word_hashes(block, starts, lengths), plan)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(block), [None, pa.py_buffer(offsets[firsts]), pa.py_buffer(data)]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, len(block)), batch.column(1).slice(block.first, len(block)), words], names=["id", "txt", "words"])


def _kept(batch: pa.RecordBatch, width: int, plan: Plan) -> Iterator[pa.RecordBatch]:
    """(id, n_words, n_removed, kept) of (id, words, runs)."""
    runs = batch.column(2).fill_null([])
    of, flat = runs.offsets.to_numpy(), runs.values.flatten()
    first, n = (x.to_numpy(zero_copy_only=False) for x in flat)
    table, edges = plan.words.block.buf, plan.words.edges
    for block in blocks(batch.column(1).cast(pa.large_binary()).view(pa.large_string()), limit=1 << 20):
        at, length, number = _tokens(block)
        firsts = np.searchsorted(at, block.offsets)
        own = slice(of[block.first], of[block.first + len(block)])
        base = np.repeat(firsts[:-1], np.diff(of[block.first : block.first + len(block) + 1]))
        gone = covered(len(at), base + first[own], n[own] + width - 1)
        left = np.flatnonzero(~gone)
        edge = np.searchsorted(left, firsts)
        index = number[left]
        spelled = index < 0
        low = np.where(spelled, len(table) + at[left], edges[index])
        # A space after each word but the last of a text.
        size = np.where(spelled, length[left], np.diff(edges, append=0)[index]) + 1
        size[edge[1:][edge[1:] > edge[:-1]] - 1] -= 1
        offsets = np.concatenate([[0], np.cumsum(size)])
        source = np.concatenate([table, block.buf])
        data = source[np.repeat(low - offsets[:-1], size) + np.arange(offsets[-1])]
        data[np.delete(offsets[1:], edge[1:][edge[1:] > edge[:-1]] - 1) - 1] = 0x20
        kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(block), [None, pa.py_buffer(offsets[edge]), pa.py_buffer(data)]).view(pa.large_string()).cast(pa.string())
        n_words = np.diff(firsts)
        yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, len(block)), pa.array(n_words), pa.array(n_words - np.diff(edge)), kept], names=["id", "n_words", "n_removed", "kept"])


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, txt, text): txt names a text beside its id, by a hash of 31 bits; zero where no id has two rows, so that it takes no room."""
    id_, text = F.col(id_col).cast("long"), F.col(text_col)
    again = docs.filter(id_.isNotNull()).groupBy(id_.alias("id")).count().filter("count > 1")
    txt = F.lit(0) if again.isEmpty() else F.xxhash64(text).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")
    return docs.select(id_.alias("id"), txt.alias("txt"), text.alias("text"))


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def plan_for(known: DataFrame, size: int, width: int = WIDTH, group_rows: int = GROUP_ROWS) -> Plan:
    """Plan for (id, txt, text) rows of ``size`` bytes of text."""
    length = min(width, anchor_words(size // 6))
    # A stretch is made for some six words, about 36 bytes; four cells for each prefix that may be over the limit.
    bits = max(12, int(4 * size / 36 / group_rows).bit_length())
    return Plan(survey(known, width, length, bits), length, bits, group_rows)


def repeated_passages(known: DataFrame, plan: Plan, width: int = WIDTH) -> DataFrame:
    """(id, txt, runs): for each text that repeats passages of smaller ids, its runs of suffixes: words first .. first + n + width - 2."""
    runs = repeat_runs(stretches(known, width, plan), width, plan)
    first, txt = F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int"), F.shiftright("place", 32).cast("int")
    return runs.groupBy("id", txt.alias("txt")).agg(F.collect_list(F.struct(first.alias("first"), "n")).alias("runs"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, group_rows: int = GROUP_ROWS, part_bytes: int = PART_BYTES) -> DataFrame:
    """(id, n_words, n_removed, kept): kept has the words left, joined by one space.

    A word goes if a window of ``width`` words over it also starts in a document of
    a smaller id.  Ids are integers.  Rows that share an id are judged each by its own
    text, and not against each other; repeated rows are judged alike.  A row without
    an id is compared with none and keeps its words.  Null texts have no words; texts
    of fewer than ``width`` words keep all; very long texts are whole; an empty table
    gives an empty result; other columns are ignored.
    """
    source = _source(docs, id_col, text_col)
    known = source.filter("id IS NOT NULL AND text IS NOT NULL")
    size = text_bytes(known)
    plan = plan_for(known, size, width, group_rows)
    runs = repeated_passages(known, plan, width)
    shared = docs.sparkSession.sparkContext.broadcast(plan)
    n_parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(100_000, -(-size // part_bytes)))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _write_texts(batch, shared.value)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _kept(batch, width, shared.value)

    written = source.mapInArrow(write, "id long, txt int, words binary").repartition(n_parts, "id", "txt")
    joined = written.join(runs, ["id", "txt"], "left").select("id", "words", "runs")
    return joined.mapInArrow(finish, "id long, n_words long, n_removed long, kept string").withColumnRenamed("id", id_col)
