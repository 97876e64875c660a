"""Helpers shared by the training-data operators.

``checkpointed`` cuts lineage through the shared checkpoint folder.  The text
helpers work on whole Arrow string buffers: words become (start, length) arrays
and 64-bit hashes without one Python object per word.
"""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but ASCII white space.
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Words of the decontamination contract, after A-Z are lower-cased.
ALNUM_OR_HIGH = np.zeros(256, dtype=bool)
ALNUM_OR_HIGH[0x30:0x3A] = True
ALNUM_OR_HIGH[0x61:0x7B] = True
ALNUM_OR_HIGH[0x80:] = True

#: Lower-cases A-Z and nothing else.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: Bytes of text handled at once; a single longer document is its own block.
BLOCK_BYTES = 4 << 20

_LANE = 0x9E3779B97F4A7C15
_MIX = 0xD6E8FEB86659FD93
_ODD = 0xC2B2AE3D27D4EB4F
_LONG_WORD = 512


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use spark.checkpoint.dir of the session; a temporary folder only where none is named and all of Spark runs in this process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="postrider-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Write df once to the shared checkpoint folder and go on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def let(value: Column, body) -> Column:
    """Bind a value once for use in higher-order functions, where Spark would inline it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release_memory() -> None:
    """Give freed memory back to the system: Python workers live on from stage to stage, beside an executor's heap."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


class Block:
    """Consecutive texts of one Arrow column in one byte buffer.

    ``first`` is the row of the batch the block starts at, ``offsets`` the byte
    offset of each text in ``buf`` (one more than there are texts); ``buf`` has
    eight spare bytes at its end so that eight bytes can be read anywhere.
    """

    def __init__(self, first: int, buf: bytes, offsets: np.ndarray):
        self.first, self.offsets = first, offsets
        self.size = len(buf)
        self.raw = buf
        self.buf = np.frombuffer(buf + b"\0" * 8, dtype=np.uint8)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.raw[self.offsets[i] : self.offsets[i + 1]]


def blocks(column: pa.Array, lower: bool = False, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Split a string column into blocks of about ``limit`` bytes; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    view = memoryview(data) if data is not None else memoryview(b"")
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), len(column))
        raw = bytes(view[offsets[row] : offsets[end]])
        yield Block(row, raw.translate(ASCII_LOWER) if lower else raw, offsets[row : end + 1] - offsets[row])
        row = end
        del raw
        release_memory()


def words_of(block: Block, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start bytes and lengths of all words, and for each text the index of its first word (one more at the end)."""
    n = block.size
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(block.offsets), np.int64)
    inside = is_word[block.buf[:n]]
    cut = np.zeros(n + 1, dtype=bool)
    cut[block.offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | cut[1:n]
    end = inside
    end[:-1] &= ~end[1:] | cut[1:n]
    starts = np.flatnonzero(start)
    lengths = np.flatnonzero(end) + 1 - starts
    return starts, lengths, np.searchsorted(starts, block.offsets)


def mix64(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(_MIX)
    h ^= h >> np.uint64(32)
    h *= np.uint64(_ODD)
    h ^= h >> np.uint64(29)
    return h


def word_hashes(block: Block, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, eight bytes at a time over all words at once."""
    h = lengths.astype(np.uint64) * np.uint64(_LANE)
    if len(starts) == 0:
        return h
    eight = np.ndarray((len(block.buf) - 7,), dtype="<u8", buffer=block.buf, strides=(1,))
    masks = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
    long = lengths > _LONG_WORD
    todo = None
    lane = 0
    while True:
        todo = np.flatnonzero((lengths > lane) & ~long) if lane else (np.flatnonzero(~long) if long.any() else slice(None))
        if lane and len(todo) == 0:
            break
        left = np.minimum(lengths[todo] - lane, 8)
        h[todo] = mix64(h[todo] + (eight[starts[todo] + lane] & masks[left]) * np.uint64(_ODD))
        lane += 8
    for i in np.flatnonzero(long):
        h[i] = xxhash.xxh64_intdigest(block.raw[starts[i] : starts[i] + lengths[i]], 7)
    return h


def word_numbers(block: Block, starts: np.ndarray, lengths: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A number for each word, equal for two words if their bytes are: hashes group them, bytes confirm the groups."""
    if len(starts) == 0:
        return np.zeros(0, np.int64)
    order = np.argsort(h)
    head = np.concatenate([[True], h[order[1:]] != h[order[:-1]]])
    first, number = order[head], np.empty(len(h), np.int64)
    number[order] = np.cumsum(head) - 1
    like = first[number]
    same = lengths == lengths[like]
    eight = np.ndarray((len(block.buf) - 7,), dtype="<u8", buffer=block.buf, strides=(1,))
    masks = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
    todo, lane = np.flatnonzero(same & (lengths <= _LONG_WORD)), 0
    while len(todo):
        different = (eight[starts[todo] + lane] ^ eight[starts[like[todo]] + lane]) & masks[np.minimum(lengths[todo] - lane, 8)] != 0
        same[todo[different]] = False
        lane += 8
        todo = todo[lengths[todo] > lane]
    word = lambda i: block.raw[starts[i] : starts[i] + lengths[i]]
    for i in np.flatnonzero(same & (lengths > _LONG_WORD)):
        same[i] = word(i) == word(like[i])
    other: dict[bytes, int] = {}
    for i in np.flatnonzero(~same):
        number[i] = len(first) + other.setdefault(word(i), len(other))
    return number


class Words:
    """A table of words that finds those of a block by hash and confirms them by their bytes."""

    def __init__(self, words: list[bytes]):
        size = np.array([len(w) for w in words], np.int64)
        self.edges = np.concatenate([[0], np.cumsum(size)])
        self.block = Block(0, b"".join(words), self.edges)
        h = word_hashes(self.block, self.edges[:-1], size)
        self.order = np.argsort(h)
        self.sorted = h[self.order]

    def __len__(self) -> int:
        return len(self.order)

    def find(self, block: Block, starts: np.ndarray, lengths: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Place in the table of each word, -1 for words that are not in it."""
        out = np.full(len(h), -1, np.int64)
        if not len(self.order) or not len(h):
            return out
        at = np.minimum(np.searchsorted(self.sorted, h), len(self.order) - 1)
        own = self.order[at]
        same = (self.sorted[at] == h) & (self.edges[own + 1] - self.edges[own] == lengths)
        ours = np.ndarray((len(block.buf) - 7,), dtype="<u8", buffer=block.buf, strides=(1,))
        theirs = np.ndarray((len(self.block.buf) - 7,), dtype="<u8", buffer=self.block.buf, strides=(1,))
        masks = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
        todo, lane = np.flatnonzero(same), 0
        while len(todo):
            different = (ours[starts[todo] + lane] ^ theirs[self.edges[own[todo]] + lane]) & masks[np.minimum(lengths[todo] - lane, 8)] != 0
            same[todo[different]] = False
            lane += 8
            todo = todo[lengths[todo] > lane]
        out[same] = own[same]
        return out


def window_hashes(h: np.ndarray, width: int, factor: int = 0x9E3779B97F4A7C55) -> np.ndarray:
    """Order-sensitive hash of each ``width`` consecutive hashes."""
    if len(h) < width:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - width + 1].copy()
    for k in range(1, width):
        out *= np.uint64(factor)
        out += h[k : len(h) - width + 1 + k]
    return mix64(out)


def covered(n: int, starts: np.ndarray, width) -> np.ndarray:
    """Boolean of length n: inside any [start, start + width)."""
    delta = np.zeros(n + 1, dtype=np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, starts + width, -1)
    return np.cumsum(delta)[:n] > 0
