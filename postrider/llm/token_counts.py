"""Token counts of whole texts by a public tokenizer, without keeping the tokens.

An Arrow function takes a batch of texts, cuts them at places where no token, and
no rule that makes tokens, can reach across, encodes each different piece once, in
calls that hold about equally many bytes, and returns lengths only.  Long texts are
cut like short ones, so no call holds more than its bytes or one uncuttable piece.

Where a text may be cut depends on the tokenizer and is checked when it is loaded:

* ``drops``: white space separates words and is no part of any token.  Every run of
  anything but ASCII white space is a piece.
* ``leads``: a space belongs to the word after it.  Cuts are before a space between two
  ASCII letters or digits.
* ``marks``: a space becomes a mark at the next word's start, which a text's start gets
  too.  Cuts are at such a space, which is left out.
* ``whole``: nothing is known, and a text is one piece.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NON_SPACE, Block, blocks, word_hashes, word_numbers, words_of

TOKENIZER = "word_bpe_49k.json"
TOKEN_LIMIT = 2048
#: Bytes of pieces in one call of the tokenizer.
CALL_BYTES = 256 << 10
#: Pieces whose counts a worker remembers, and the longest of them; when full it starts anew, so this is no matter of results.
REMEMBERED, REMEMBERED_BYTES = 200_000, 64

_ALNUM = np.zeros(256, dtype=bool)
for _low, _high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
    _ALNUM[_low:_high] = True

_loaded: dict[str, Tokens] = {}


class Tokens:
    """A tokenizer file with its rule for cuts; counts pieces in calls of about ``CALL_BYTES``."""

    def __init__(self, path: str):
        self.known: dict[bytes, int] = {}
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: model.encode(texts, num_threads=1)
            pieces = (model.id_to_piece(i).lstrip("▁") for i in range(model.get_piece_size()))
            apart = not any("▁" in p or " " in p for p in pieces) and all(model.encode(x, out_type=str)[:1] == model.encode("a " + x, out_type=str)[1:2] for x in ("a", "1"))
            self.cuts = "marks" if apart else "whole"
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks have the cores
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self.encode = lambda texts: model.encode_batch_fast(texts, add_special_tokens=False)
            self.cuts = _cuts_of(json.loads(model.to_str()))

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """Tokens of each piece."""
        out = np.fromiter((self.known.get(p, -1) for p in pieces), np.int64, len(pieces))
        new = np.flatnonzero(out < 0)
        size = np.fromiter((len(pieces[i]) for i in new), np.int64, len(new))
        call = np.cumsum(size) // CALL_BYTES
        for own in np.split(new, np.flatnonzero(np.diff(call)) + 1) if len(new) else []:
            out[own] = [len(x) for x in self.encode([pieces[i].decode() for i in own])]
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
        self.known.update((pieces[i], int(out[i])) for i in new[:REMEMBERED] if len(pieces[i]) <= REMEMBERED_BYTES)
        return out


def _cuts_of(spec: dict) -> str:
    """Rule for cuts of a tokenizer's JSON form, from its steps and added tokens."""
    added = spec.get("added_tokens") or []
    if any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") or any(c.isspace() for c in x["content"]) for x in added):
        return "whole"
    steps = lambda x, many: [] if not x else x.get(many, [x])
    before, split = steps(spec.get("normalizer"), "normalizers"), steps(spec.get("pre_tokenizer"), "pretokenizers")
    pattern = lambda x: (x.get("pattern") or {}).get("Regex", "")
    plain = all(x["type"] in ("NFC", "Lowercase") or x["type"] == "Replace" and pattern(x) == r"\s+" and x["content"] == " " for x in before)
    if not plain or not split:
        return "whole"
    first, rest = split[0], split[1:]
    in_place = all(x["type"] == "ByteLevel" and not x["use_regex"] and not x["add_prefix_space"] for x in rest)
    # Each alternative of the pattern is a contraction or a class without white space; what it does not match is dropped.
    if first["type"] == "Split" and first["behavior"] == "Removed" and first["invert"] and in_place and all(_without_space(x) for x in pattern(first).split("|")):
        return "drops"
    if first["type"] == "ByteLevel" and first["use_regex"] and not first["add_prefix_space"] and not rest and not before:
        return "leads"
    return "whole"


def _without_space(alternative: str) -> bool:
    return alternative.startswith("'") and alternative[1:].isalpha() or alternative in (r"[\p{L}]+", r"[\p{N}]", r"[^\s\p{L}\p{N}]+")


def _tokens(name: str) -> Tokens:
    """The tokenizer of a path, or of a name that the public tokenizers have; loaded once a worker."""
    if name not in _loaded:
        path = name
        if not os.path.exists(path):
            import public_tokenizers

            path = public_tokenizers.path(name)
        _loaded[name] = Tokens(path)
    return _loaded[name]


def pieces_of(block: Block, cuts: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start bytes and lengths of the pieces of a block's texts, and for each text the index of its first piece (one more at the end)."""
    if cuts == "drops":
        return words_of(block, NON_SPACE)
    edges, n = block.offsets, block.size
    at = np.zeros(0, np.int64)
    if cuts != "whole" and n > 2:
        raw = block.buf[:n]
        fits = (raw[1:-1] == 0x20) & _ALNUM[raw[:-2]] & _ALNUM[raw[2:]]
        inner = np.ones(n + 1, dtype=bool)
        inner[edges] = False  # a text's first byte is no cut, nor has its last byte a next one
        at = np.flatnonzero(fits & inner[1 : n - 1] & inner[2:n]) + 1
    # A text starts a piece even where it is empty; cuts come after the starts of texts before them.
    starts = np.concatenate([edges[:-1], at])
    order = np.argsort(starts, kind="stable")
    text = np.concatenate([np.arange(len(block)), np.searchsorted(edges, at, side="right") - 1])[order]
    left_out = np.concatenate([np.zeros(len(block), np.int64), np.full(len(at), cuts == "marks")])[order]
    starts = starts[order]
    ends = np.append(starts[1:], n)
    last = np.append(text[1:] != text[:-1], True) if len(text) else np.zeros(0, bool)
    ends[last] = edges[1:][text[last]]
    return starts + left_out, ends - starts - left_out, np.searchsorted(text, np.arange(len(block) + 1))


def count_tokens(texts: pa.Array, tokens: Tokens) -> np.ndarray:
    """Number of tokens of each text; null counts as empty."""
    out = np.zeros(len(texts), np.int64)
    for block in blocks(texts):
        starts, lengths, firsts = pieces_of(block, tokens.cuts)
        if len(starts) == 0:
            continue
        number = word_numbers(block, starts, lengths, word_hashes(block, starts, lengths))
        _, one = np.unique(number, return_index=True)
        counts = np.zeros(int(number.max()) + 1, np.int64)
        counts[number[one]] = tokens.count([block.raw[s : s + n] for s, n in zip(starts[one].tolist(), lengths[one].tolist())])
        total = np.concatenate([[0], np.cumsum(counts[number])])
        out[block.first : block.first + len(block)] = total[firsts[1:]] - total[firsts[:-1]]
    return out


def token_count(text: Column, tokenizer: str = TOKENIZER) -> Column:
    """Number of tokens of a text column: a long; null texts have none."""

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        return pa.array(count_tokens(texts, _tokens(tokenizer)))

    return count(text)


def add_token_counts(docs: DataFrame, text_col: str = "text", tokenizer: str = TOKENIZER, limit: int = TOKEN_LIMIT) -> DataFrame:
    """Add n_bytes, n_tokens and over_limit (more than ``limit`` tokens) to every row of docs.

    ``tokenizer`` is a path, or a name of the public tokenizers: .json for the
    library tokenizers, .model for sentencepiece.  No begin, end or other special
    token is added, nothing is truncated or padded, and a special token's own text
    inside a document counts as the library has it by default.  Null and empty
    texts have 0 bytes and 0 tokens; texts of any length are counted whole; every
    row is kept and judged by itself, repeats and rows without an id too, and there are no
    ties.  Input columns called n_bytes, n_tokens or over_limit are replaced; other
    columns stay as they are.  An empty table gives an empty result.  Nothing is shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = docs.withColumns({"n_bytes": F.octet_length(text).cast("long"), "n_tokens": token_count(F.col(text_col), tokenizer)})
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
