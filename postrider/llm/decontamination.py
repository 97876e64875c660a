"""Benchmark decontamination by Wu-Manber search over words.

Every window of ``width`` consecutive benchmark words is a pattern (an item of
fewer words is one pattern).  Patterns of one length share a SHIFT table over
blocks of two words and buckets keyed by the hash of a pattern's last block.  The
scan runs over many stretches of text in lock step: each step reads the block at
the stretch's position and moves on by that block's shift, so positions no
pattern can end at are never looked at.  Shift zero opens a bucket; its patterns
are compared by digest and then word for word.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM_OR_HIGH, ASCII_LOWER, Block, blocks, covered, mix64, word_hashes, words_of

WIDTH = 10
#: Bytes of benchmark text in one broadcast table; more text is searched in several passes.
SHARD_BYTES = 8 << 20
#: End positions that one lane of the lock-step scan covers.
STRETCH = 256
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_A = np.uint64(0x9E3779B97F4A7C55)
RESULT = "{id} {type}, n_words long, n_hit long, n_items long, items array<{item}>, hit binary"


def _hash_words(words: list[bytes]) -> np.ndarray:
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    block = Block(0, b"".join(words), np.concatenate([[0], np.cumsum(lengths)]))
    return word_hashes(block, block.offsets[:-1], lengths)


def _pairs(h: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the block that ends at each position: two words."""
    return mix64(h[ends - 1] * _A + h[ends])


class Table:
    """SHIFT table and suffix buckets of the patterns of one length."""

    def __init__(self, length: int, patterns: list[tuple[bytes, ...]], items: list[list[int]]):
        self.length, self.patterns, self.items = length, patterns, items
        h = _hash_words([w for p in patterns for w in p]).reshape(len(patterns), length)
        self.digest = self._digest(h.T)
        if length == 1:
            last, every, shift = h[:, 0], h[:, 0], np.zeros(len(h), np.int64)
        else:
            at = [mix64(h[:, j - 1] * _A + h[:, j]) for j in range(1, length)]
            last = at[-1]
            every = np.concatenate(at)
            shift = np.repeat(np.arange(length - 2, -1, -1), len(patterns))
        order = np.lexsort((shift, every))
        self.keys, first = np.unique(every[order], return_index=True)
        self.shift = shift[order][first].astype(np.int64)
        self.most = max(1, length - 1)
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[(self.keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        order = np.argsort(last, kind="stable")
        self.bucket_of, self.bucket_at = np.unique(last[order], return_index=True)
        self.bucket_at = np.append(self.bucket_at, len(last))
        self.members = order

    @staticmethod
    def _digest(columns) -> np.ndarray:
        out = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            out = out * _A + c
        return out

    def shifts(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), self.most, dtype=np.int64)
        near = np.flatnonzero(self.maybe[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if len(near):
            at = np.minimum(np.searchsorted(self.keys, keys[near]), len(self.keys) - 1)
            same = self.keys[at] == keys[near]
            out[near[same]] = self.shift[at[same]]
        return out

    def occurrences(self, block: Block, starts, lengths, firsts, h) -> tuple[np.ndarray, np.ndarray]:
        """First word and pattern number of every occurrence in the block's texts."""
        m = self.length
        n_ends = np.maximum(np.diff(firsts) - m + 1, 0)
        lanes = -(-n_ends // STRETCH)
        text = np.repeat(np.arange(len(n_ends)), lanes)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = firsts[:-1][text] + m - 1 + nth * STRETCH
        stop = np.minimum(at + STRETCH, firsts[1:][text])
        hits = []
        while len(at):
            key = _pairs(h, at) if m > 1 else h[at]
            shift = self.shifts(key)
            zero = shift == 0
            if zero.any():
                hits.append((at[zero], key[zero]))
            at = at + np.maximum(shift, 1)
            go = at < stop
            at, stop = at[go], stop[go]
        none = np.zeros(0, np.int64)
        if not hits:
            return none, none
        ends, key = np.concatenate([x for x, _ in hits]), np.concatenate([x for _, x in hits])
        bucket = np.searchsorted(self.bucket_of, key)
        size = self.bucket_at[bucket + 1] - self.bucket_at[bucket]
        ends, low = np.repeat(ends, size), np.repeat(self.bucket_at[bucket], size)
        nth = np.arange(len(ends)) - np.repeat(np.cumsum(size) - size, size)
        pattern = self.members[low + nth]
        begin = ends - m + 1
        same = self._digest([h[begin + j] for j in range(m)]) == self.digest[pattern]
        begin, pattern = begin[same], pattern[same]
        raw = block.raw
        exact = np.fromiter(
            (all(raw[starts[b + j] : starts[b + j] + lengths[b + j]] == w for j, w in enumerate(self.patterns[p])) for b, p in zip(begin, pattern)),
            dtype=bool, count=len(begin),
        )
        return begin[exact], pattern[exact]


def build_tables(items: list[tuple[object, str | None]], width: int = WIDTH) -> tuple[list[Table], list]:
    """Tables for all pattern lengths, and the item ids that patterns refer to by position."""
    found: dict[tuple[bytes, ...], set[int]] = {}
    place = {i: k for k, i in enumerate(dict.fromkeys(i for i, _ in items))}
    for item, text in items:
        i = place[item]
        words = _WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER))
        for j in range(max(len(words) - width, 0) + 1 if words else 0):
            found.setdefault(tuple(words[j : j + width]), set()).add(i)
    lengths = sorted({len(p) for p in found})
    groups = [[p for p in found if len(p) == m] for m in lengths]
    return [Table(m, g, [sorted(found[p]) for p in g]) for m, g in zip(lengths, groups)], list(place)


def _scan(batch: pa.RecordBatch, tables: list[Table], ids: list, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for block in blocks(batch.column(1), lower=True):
        starts, lengths, firsts = words_of(block, ALNUM_OR_HIGH)
        h = word_hashes(block, starts, lengths)
        hit = np.zeros(len(starts), dtype=bool)
        doc_item = [np.zeros(0, np.int64)]
        for table in tables:
            begin, pattern = table.occurrences(block, starts, lengths, firsts, h)
            if len(begin):
                hit |= covered(len(starts), begin, table.length)
                doc = np.searchsorted(firsts, begin, side="right") - 1
                per = [table.items[p] for p in pattern]
                doc_item.append(np.repeat(doc, [len(x) for x in per]) * len(ids) + np.concatenate([np.array(x) for x in per]))
        pairs = np.unique(np.concatenate(doc_item))
        of = np.split(pairs % max(len(ids), 1), np.searchsorted(pairs // max(len(ids), 1), np.arange(1, len(block))))
        hits = np.concatenate([[0], np.cumsum(hit)])[firsts]
        rows = range(len(block))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).slice(block.first, len(block)),
                pa.array(np.diff(firsts)),
                pa.array(np.diff(hits)),
                pa.array([len(of[i]) for i in rows], pa.int64()),
                pa.array([[ids[k] for k in of[i]] for i in rows], schema.field(4).type),
                pa.array([np.packbits(hit[firsts[i] : firsts[i + 1]]).tobytes() if len(of[i]) else b"" for i in rows], pa.binary()),
            ],
            schema=schema,
        )


def _shards(benchmark: DataFrame, item_col: str, text_col: str, width: int, shard_bytes: int) -> list:
    """Broadcast tables of the benchmark, each of about ``shard_bytes`` of its text at most."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-int(total) // shard_bytes))
    parts = [items] if n == 1 else [items.filter(F.pmod(F.xxhash64("item"), F.lit(n)) == k) for k in range(n)]
    return [spark.sparkContext.broadcast(build_tables([tuple(r) for r in part.collect()], width)) for part in parts]


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items (ids, unordered) and hit (bits of its words, empty if none is hit).

    The benchmark is broadcast in shards of at most ``shard_bytes`` of text, each
    searched over all documents; a document's rows of several shards (one per
    shard, so a bounded number) are combined.  Rows repeated, or without an id, keep
    a row each; rows of one item count as one item.  Null and empty texts have no
    words and no hits; an empty benchmark hits nothing; other columns are ignored.
    """
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    shards = _shards(benchmark, item_col, item_text_col, width, shard_bytes)
    # Shards are combined by id and text, since ids may be null or repeated.
    key = F.col(id_col) if len(shards) == 1 else F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text"))
    source = docs.select(key.alias("id"), F.col(text_col).alias("text"))
    schema = RESULT.format(id="id", type=source.schema["id"].dataType.simpleString(), item=items.schema["item"].dataType.simpleString())
    arrow = T.StructType.fromDDL(schema)
    found = None
    for table in shards:

        def search(batches: Iterator[pa.RecordBatch], table=table) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_schema

            out = to_arrow_schema(arrow)
            tables, ids = table.value
            for batch in batches:
                yield from _scan(batch, tables, ids, out)

        one = source.mapInArrow(search, schema)
        found = one if found is None else found.unionByName(one)
    if len(shards) > 1:
        bits = F.pandas_udf(_union_bits, "struct<n:bigint,bits:binary>")
        copies = F.sequence(F.lit(1), (F.count("*") / len(shards)).cast("int"))
        found = found.groupBy("id").agg(F.first("n_words").alias("n_words"), F.flatten(F.collect_set("items")).alias("items"), F.collect_set("hit").alias("hit"), copies.alias("copies"))
        found = found.withColumn("hit", bits("hit")).withColumn("copy", F.explode("copies"))
        found = found.select("id.id", "n_words", F.col("hit.n").alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", F.col("hit.bits").alias("hit"))
    return found.withColumnRenamed("id", id_col)


def clean_rows(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", width: int = WIDTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Rows of docs without any hit, all columns kept; nulls and empty texts have none.

    A filter on the rows themselves, one for each shard of the benchmark, so nothing is shuffled.
    """
    out = docs
    for table in _shards(benchmark, "item_id", "text", width, shard_bytes):
        out = out.filter(_free_of(table)(F.col(text_col)))
    return out


def _free_of(table):
    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        tables, _ = table.value
        free = np.ones(len(texts), dtype=bool)
        for block in blocks(texts, lower=True):
            starts, lengths, firsts = words_of(block, ALNUM_OR_HIGH)
            h = word_hashes(block, starts, lengths)
            for t in tables:
                begin, _ = t.occurrences(block, starts, lengths, firsts, h)
                free[block.first + np.searchsorted(firsts, begin, side="right") - 1] = False
        return pa.array(free)

    return clean


def _union_bits(column):
    import pandas as pd

    n, bits = [], []
    for maps in column:
        maps = [np.frombuffer(x, np.uint8) for x in maps if len(x)]
        both = np.bitwise_or.reduce(maps) if maps else np.zeros(0, np.uint8)
        n.append(int(np.unpackbits(both).sum()))
        bits.append(both.tobytes())
    return pd.DataFrame({"n": n, "bits": bits})


def items_digest(items):
    """SHA-256 of the item ids, sorted as strings and comma-joined."""
    return F.sha2(F.array_join(F.array_sort(F.transform(items, lambda i: i.cast("string"))), ","), 256)


def brute_force(docs: list[tuple], items: list[tuple], width: int = WIDTH) -> dict:
    """Plain Python version for tests: id -> (n_words, n_hit, sorted item ids as strings)."""
    def words(t):
        return _WORD.findall((t or "").encode().translate(ASCII_LOWER))

    patterns = []
    for i, t in items:
        w = words(t)
        patterns += [(i, w[j : j + width]) for j in range(max(len(w) - width, 0) + 1 if w else 0)]
    out = {}
    for d, t in docs:
        w, hit, own = words(t), set(), set()
        for i, p in patterns:
            for j in range(len(w) - len(p) + 1):
                if w[j : j + len(p)] == p:
                    hit.update(range(j, j + len(p)))
                    own.add(str(i))
        out[d] = (len(w), len(hit), sorted(own))
    return out


def digest_of(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
