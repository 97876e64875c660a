"""Vector compression by product codebooks, trained and applied in whole numbers.

Components become integers, vectors are cut into parts, and each part is replaced
by the number of its nearest codebook entry.  Codebooks are trained over all
vectors: each round assigns every part and averages the parts of an entry, with
sums that leave a task only as one row an entry and component.

Nearest entries are found by partial distances: components are taken in the order
of falling variance among the entries, and an entry is dropped once what it has
gathered exceeds the best whole distance known so far.  Masks do that for a block
of rows at once.  All arithmetic is exact, so the result does not depend on the
order of rows, components or tasks.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

PARTS = 4
ENTRIES = 256
ROUNDS = 4
UNIT = 1024
#: Most different labels whose sums are broadcast whole: some 16 MB.
BROADCAST_LABELS = 500_000
#: Labels with over one in so many rows are broadcast in any case; there are at most as many of them.
COMMON = 1000
_ROWS = 512
#: Components between two looks at which entries are left.
_STRIDE = 4


@dataclass
class Codebook:
    """``entries[p]`` holds part p's entries, a row each."""

    entries: np.ndarray

    @property
    def parts(self) -> int:
        return self.entries.shape[0]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def furthest(dim: int) -> int:
    """Integers are held to this size, at which a squared distance still fits a long."""
    return math.isqrt((1 << 62) // max(dim, 1)) // 2


def integers(vectors: pa.Array, dim: int) -> np.ndarray:
    """A row of floored integers for each vector of ``dim`` finite components."""
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(vectors), dim)
    reach = furthest(dim)
    return np.clip(np.floor(UNIT * flat), -reach, reach).astype(np.int64)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest entry (ties: the lower) and its squared distance, by partial distances.

    A row's best whole distance starts as that of the entry which leads after the
    first components, and is renewed from the entry that leads at each later look.  Pairs of a row
    and an entry are dropped when what they have gathered is strictly more.
    """
    n, m = x.shape
    reach = int(max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)))
    kind = np.int32 if m * (2 * reach) ** 2 < 2**31 else np.int64
    by_variance = np.argsort(-entries.astype(np.float64).var(axis=0), kind="stable")
    x, entries = x[:, by_variance].astype(kind), np.ascontiguousarray(entries[:, by_variance].astype(kind))
    which, least = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for low in range(0, n, _ROWS):
        part = x[low : low + _ROWS]
        gathered = np.zeros((len(part), len(entries)), kind)
        for k in range(min(_STRIDE, m)):
            gap = part[:, k, None] - entries[None, :, k]
            gap *= gap
            gathered += gap
        lead = gathered.argmin(axis=1)
        best = _whole(part, entries, lead)
        row, entry = np.nonzero(gathered <= best[:, None])  # by row, then by entry
        gathered = gathered[row, entry]
        for start in range(_STRIDE, m, _STRIDE):
            for k in range(start, min(start + _STRIDE, m)):
                gap = part[row, k] - entries[entry, k]
                gathered += gap * gap
            first = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1])
            leads = gathered == np.minimum.reduceat(gathered, first)[np.cumsum(np.concatenate([[0], np.diff(row) != 0]))]
            lead[row[leads][::-1]] = entry[leads][::-1]
            np.minimum(best, _whole(part, entries, lead), out=best)
            left = gathered <= best[row]
            row, entry, gathered = row[left], entry[left], gathered[left]
        # What is left has whole distances, and equals the best: the lowest entry of each row comes first.
        first = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1])
        which[low : low + len(part)], least[low : low + len(part)] = entry[first], gathered[first]
    return which, least


def _whole(part: np.ndarray, entries: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    return ((part - entries[chosen]) ** 2).sum(axis=1, dtype=part.dtype)


def finite(vector: Column) -> Column:
    """Vectors that are there, whole, and finite."""
    size = F.lit(float("inf"))
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < size)
    return F.coalesce(vector.isNotNull() & F.forall(vector, good), F.lit(False))


def kept_vectors(rows: DataFrame, id_col: str, vector_col: str, parts: int) -> tuple[DataFrame, int]:
    """Rows whose vectors can be coded, and their dimension: that of the smallest id's among those of finite components that can be cut into equal parts."""
    size = F.size(vector_col)
    usable = rows.filter(finite(F.col(vector_col)) & (size > 0) & (size % parts == 0))
    first = usable.orderBy(F.col(id_col).asc_nulls_last(), vector_col).select(size.alias("dim")).limit(1).collect()
    dim = first[0].dim if first else 0
    return usable.filter(size == dim), dim


def train(kept: DataFrame, dim: int, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebook:
    """Codebooks of all kept vectors; the first entries are the vectors of the smallest ids (a bounded top-k)."""
    first = kept.orderBy(F.col(id_col).asc_nulls_last(), vector_col).select(vector_col).limit(entries).collect()
    start = integers(pa.array([r[0] for r in first], pa.list_(pa.float64())), dim)
    book = Codebook(np.ascontiguousarray(start.reshape(len(start), parts, dim // parts).transpose(1, 0, 2)))
    for _ in range(rounds):
        book = improved(kept, dim, vector_col, book)
    return book


def improved(kept: DataFrame, dim: int, vector_col: str, book: Codebook) -> Codebook:
    """One round: every entry becomes the floored mean of the parts that are nearest to it; unused entries stay."""
    shared = kept.sparkSession.sparkContext.broadcast(book)

    def gather(batches):
        entries = shared.value.entries
        parts, k, m = entries.shape
        total, count = np.zeros((parts, k, m), np.int64), np.zeros((parts, k), np.int64)
        for batch in batches:
            x = integers(batch.column(0), dim).reshape(batch.num_rows, parts, m)
            for p in range(parts):
                near, _ = nearest(x[:, p], entries[p])
                count[p] += np.bincount(near, minlength=k)
                order = np.argsort(near, kind="stable")
                used, at = np.unique(near[order], return_index=True)
                total[p, used] += np.add.reduceat(x[order, p], at, axis=0)
        used = np.flatnonzero(count.ravel())
        # A row for each component of an entry that was met, and one, with number m, for its count.
        sums = np.concatenate([total.reshape(-1, m)[used], count.ravel()[used, None]], axis=1)
        columns = [pa.array(np.repeat(used, m + 1)), pa.array(np.tile(np.arange(m + 1), len(used))), pa.array(sums.ravel())]
        yield pa.RecordBatch.from_arrays(columns, names=["entry", "component", "total"])

    sums = kept.select(vector_col).mapInArrow(gather, "entry long, component long, total long").groupBy("entry", "component").agg(F.sum("total").alias("total")).collect()
    parts, k, m = book.entries.shape
    total = np.zeros((parts * k, m + 1), np.int64)
    for r in sums:
        total[r.entry, r.component] = r.total
    new, used = book.entries.reshape(-1, m).copy(), total[:, m] > 0
    new[used] = total[used, :m] // total[used, m:]
    return Codebook(new.reshape(parts, k, m))


def encode(kept: DataFrame, dim: int, book: Codebook, vector_col: str = "embedding") -> DataFrame:
    """Add code (two hex digits a part, or as many as the entries need) and error, the squared distance between a vector and its code."""
    shared = kept.sparkSession.sparkContext.broadcast(book)
    digits = max(2, len(f"{book.entries.shape[1] - 1:x}"))

    @F.arrow_udf("struct<code:string,error:bigint>")
    def code(vectors: pa.Array) -> pa.Array:
        entries = shared.value.entries
        parts, k, m = entries.shape
        x = integers(vectors, dim).reshape(len(vectors), parts, m)
        found = [nearest(x[:, p], entries[p]) for p in range(parts)]
        names = np.array([f"{i:0{digits}x}" for i in range(k)])
        text = ["".join(c) for c in zip(*(names[which] for which, _ in found))]
        return pa.StructArray.from_arrays([pa.array(text, pa.string()), pa.array(sum(e.astype(np.int64) for _, e in found))], names=["code", "error"])

    coded = kept.withColumn("_c", code(F.col(vector_col)))
    return coded.withColumns({"code": F.col("_c.code"), "error": F.col("_c.error")}).drop("_c")


def decode(book: Codebook, code: str) -> list[float]:
    """The vector that a code stands for."""
    digits = len(code) // book.parts
    return [x / UNIT for p in range(book.parts) for x in book.entries[p, int(code[p * digits : (p + 1) * digits], 16)].tolist()]


def with_label_error(coded: DataFrame, label_col: str) -> DataFrame:
    """Add label_error, the errors summed over rows of equal labels, nulls together; labels with many rows are never dealt out by label."""
    rows = checkpointed(coded)
    sums = checkpointed(rows.groupBy(F.col(label_col).alias("_label")).agg(F.sum("error").alias("label_error"), F.count("*").alias("_n")))
    size = sums.agg(F.count("*").alias("labels"), F.sum("_n").alias("rows")).first()
    same = F.col(label_col).eqNullSafe(F.col("_label"))
    give = lambda found: found.drop("_label", "_n")
    if size.labels <= BROADCAST_LABELS:
        return give(rows.join(F.broadcast(sums), same))
    often = sums.filter(F.col("_n") * COMMON > size.rows)
    hot, cold = F.broadcast(often), sums.filter(F.col("_n") * COMMON <= size.rows)
    return give(rows.join(hot, same)).unionByName(give(rows.join(cold, same)))


def compress(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Train codebooks over all vectors and code them: the kept rows with code, error, label_error and codebooks_sha256, without their vectors.

    Rows are dropped where the vector is null, has a null or non-finite component,
    is empty, or differs in length from the vector of the smallest id (among those that
    can be cut into equal parts).  Integers beyond ``furthest`` (131,072 times
    1024 at 64 dimensions) are held to it, so that every squared distance fits a long.  Rows without an id are coded, and come last where the first
    entries are chosen; of rows that share an id the lesser vector comes first; with fewer
    rows than entries there are as many entries as rows.  Repeated rows each count.
    Other columns stay; input columns of the added names are replaced.  An empty
    table gives an empty result.  Only the codebooks are held by driver and tasks.
    """
    rows = rows.drop("code", "error", "label_error", "codebooks_sha256")
    kept, dim = kept_vectors(rows, id_col, vector_col, parts)
    if dim == 0:
        empty = {"code": "string", "error": "long", "label_error": "long", "codebooks_sha256": "string"}
        return kept.drop(vector_col).withColumns({k: F.lit(None).cast(t) for k, t in empty.items()})
    book = train(kept, dim, id_col, vector_col, parts, entries, rounds)
    coded = encode(kept, dim, book, vector_col).drop(vector_col)
    return with_label_error(coded, label_col).withColumn("codebooks_sha256", F.lit(book.sha256()))
