"""SimHash fingerprints, near-duplicate links and their components.

Fingerprints are collapsed to distinct values before anything is compared.  Two
values at ``radius`` or fewer differing bits agree on at least ``parts - radius``
of ``parts`` bit groups, so values are brought together by each choice of that
many groups.  Inside such a bucket a table of Hamming distances to reference
fingerprints (pivots) discards pairs: by the triangle inequality, two values whose
distances to any pivot differ by more than ``radius`` cannot be linked.  Rows are
sorted by the first pivot, so only a band of them is looked at; survivors of the
largest coordinate difference are verified by XOR and bit count.  Buckets over
``bucket_rows`` are split into tiles that are paired.  A task returns a spanning
forest of the links it found, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_LOWER, checkpointed

SEED = 42
SHINGLE = 3
RADIUS = 3
PIVOTS = 16
BUCKET_ROWS = 4096
_BATCH = 200_000


def _shingle_hashes(text: bytes, size: int) -> bytes:
    """Big-endian XXH64 values of all word shingles of a lower-cased text."""
    norm = b" ".join(text.translate(ASCII_LOWER).split())
    if not norm:
        return b""
    spaces = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    if len(spaces) < size - 1:
        return xxhash.xxh64_digest(norm, SEED)
    starts = [0, *(spaces[: len(spaces) - size + 2] + 1).tolist()]
    ends = [*spaces[size - 1 :].tolist(), len(norm)]
    digest = xxhash.xxh64_digest
    return b"".join([digest(norm[s:e], SEED) for s, e in zip(starts, ends)])


def _majority(digests: list[bytes]) -> np.ndarray:
    """Fingerprint of each list of hashes: bits set in over half of them."""
    out = np.zeros(len(digests), np.uint64)
    for i, d in enumerate(digests):
        n = len(d) // 8
        if not n:
            continue
        counts = np.zeros(64, np.int64)
        for k in range(0, n, _BATCH):
            part = np.frombuffer(d, np.uint8, offset=8 * k, count=8 * min(_BATCH, n - k)).reshape(-1, 8)
            counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
        out[i] = int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(id, fp long): SimHash of each whole text; null and word-less texts get zero."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            fps = np.zeros(len(texts), np.uint64)
            for k in range(0, len(texts), 64):
                part = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in texts.slice(k, 64)]
                fps[k : k + len(part)] = _majority([_shingle_hashes(t, size) for t in part])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=[id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: fixed pseudo-random values."""
    return np.random.default_rng(20240229).integers(0, 1 << 64, n, dtype=np.uint64)


def bit_parts(parts: int) -> list[int]:
    """Masks that split 64 bits into ``parts`` groups of nearly equal size."""
    edges = [64 * i // parts for i in range(parts + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]


def choose_parts(n: int, radius: int = RADIUS) -> int:
    """Fewest bit groups whose keys leave some 32 of ``n`` evenly spread values in a bucket."""
    parts = radius + 1
    while parts < radius + 6 and n / 2 ** (64 * (parts - radius) / parts) > 32:
        parts += 1
    return parts


def _forest(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Smallest member reachable by links among 0..n-1, by hooking and pointer jumping."""
    root = np.arange(n)
    while True:
        a, b = root[left], root[right]
        low, high = np.minimum(a, b), np.maximum(a, b)
        if (low == high).all():
            return root
        np.minimum.at(root, high, low)
        while not (root == (up := root[root])).all():
            root = up


def bucket_links(fps: np.ndarray, side: np.ndarray | None, table: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of linked values of one bucket, as a spanning forest.

    ``table`` has the pivot distances, a row per pivot.  With ``side``, only pairs of unequal sides are compared.
    """
    n = len(fps)
    order = np.argsort(table[0], kind="stable")
    fps, table = fps[order], table[:, order]
    side = None if side is None else side[order]
    upto = np.searchsorted(table[0], table[0] + radius, side="right")
    root = np.arange(n)
    step = max(1, (1 << 20) // max(1, int((upto - np.arange(n)).max(initial=1))))
    for k in range(0, n, step):
        i = np.arange(k, min(k + step, n))
        size = upto[i] - i - 1
        a = np.repeat(i, size)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(size) - size, size)
        if side is not None:
            keep = side[a] != side[b]
            a, b = a[keep], b[keep]
        for row in table[1:]:
            if not len(a):
                break
            keep = np.abs(row[a] - row[b]) <= radius
            a, b = a[keep], b[keep]
        near = np.bitwise_count(fps[a] ^ fps[b]) <= radius
        if near.any():
            a, b = root[a[near]], root[b[near]]
            join = _forest(a, b, n)
            root = join[root]
    moved = np.flatnonzero(root != np.arange(n))
    return order[moved], order[root[moved]]


def _links_of_group(pdf: pd.DataFrame, radius: int, n_pivots: int) -> pd.DataFrame:
    pdf = pdf.sort_values("bucket", kind="stable")
    fps = pdf["fp"].to_numpy().view(np.uint64)
    node, bucket, side = pdf["node"].to_numpy(), pdf["bucket"].to_numpy(), pdf["side"].to_numpy()
    table = np.stack([np.bitwise_count(fps ^ p).astype(np.int16) for p in pivots(n_pivots)])
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    found = []
    for lo, hi in zip([0, *cuts], [*cuts, len(bucket)]):
        if hi - lo > 1:
            own = side[lo:hi] if (side[lo:hi] >= 0).all() else None
            i, j = bucket_links(fps[lo:hi], own, table[:, lo:hi], radius)
            if len(i):
                found.append((node[lo:hi][i], node[lo:hi][j]))
    if not found:
        return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    a, b = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
    return pd.DataFrame({"a": np.maximum(a, b), "b": np.minimum(a, b)}).drop_duplicates()


def links(values: DataFrame, n_values: int, radius: int = RADIUS, n_pivots: int = PIVOTS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links (a > b) between nodes of ``values`` (node, fp distinct); enough of them to connect all that are linked."""
    parts = choose_parts(n_values, radius)
    masks = bit_parts(parts)
    keys = [sum(masks[i] for i in chosen) for chosen in combinations(range(parts), parts - radius)]
    signed = [k - (1 << 64) if k >> 63 else k for k in keys]
    keyed = values.select(
        "node", "fp",
        F.posexplode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(signed)])).alias("scheme", "bucket"),
    ).drop("scheme")
    sizes = keyed.groupBy("bucket").count()
    hot = checkpointed(sizes.filter(F.col("count") > bucket_rows))
    n_tasks = int(max(1, min(100_000, n_values * len(keys) // 50_000)))
    if hot.isEmpty():
        dealt = keyed.withColumn("side", F.lit(-1))
    else:
        # A hot bucket is cut into t tiles; tile pairs (i, j) become buckets of their own.
        tile = hot.withColumn("tiles", F.ceil(F.col("count") * 2 / bucket_rows).cast("int")).drop("count")
        marked = keyed.join(tile, "bucket", "left")
        own = F.pmod(F.xxhash64(F.lit(7), F.col("fp")), F.col("tiles")).cast("int")
        pairs = F.transform(
            F.sequence(F.lit(0), F.col("tiles") - 1),
            lambda j: F.struct(F.least(j, own).alias("i"), F.greatest(j, own).alias("j")),
        )
        split = marked.filter(F.col("tiles").isNotNull()).withColumn("own", own).withColumn("pair", F.explode(pairs))
        split = split.select(
            "node", "fp",
            F.xxhash64("bucket", "pair.i", "pair.j").alias("bucket"),
            F.when(F.col("pair.i") == F.col("pair.j"), F.lit(-1)).when(F.col("own") == F.col("pair.i"), F.lit(0)).otherwise(F.lit(1)).alias("side"),
        )
        dealt = marked.filter(F.col("tiles").isNull()).select("node", "fp", "bucket", F.lit(-1).alias("side")).unionByName(split)
    task = F.pmod(F.col("bucket"), F.lit(n_tasks))
    grouped = dealt.withColumn("task", task).groupBy("task")
    return grouped.applyInPandas(lambda pdf: _links_of_group(pdf, radius, n_pivots), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node on an edge: alternating large-star and small-star steps until nothing changes.

    Each round keeps at most a few rows per node, and its table is checkpointed.
    """
    edges = checkpointed(edges.select("a", "b").filter("a <> b").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = checkpointed(small.filter("a <> b").distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, n_pivots: int = PIVOTS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(id, fingerprint hex, component_id): one row per document, component_id the smallest id reachable by links.

    Ids are integers.  Texts are linked by their fingerprints alone, so rows that share
    an id do not link its texts.  A row without an id names no component: where no row
    of its component has an id, component_id is null.  Null, empty and word-less texts
    have fingerprint zero and are linked like any other; repeated rows keep a row each;
    texts are whole, however long; an empty table gives an empty result; other columns
    are ignored.
    """
    fps = checkpointed(fingerprints(docs, id_col, text_col).withColumnRenamed(id_col, "id"))
    values = checkpointed(fps.groupBy("fp").agg(F.min("id").alias("least")))
    found = components(links(values.select(F.col("fp").alias("node"), "fp"), values.count(), radius, n_pivots, bucket_rows))
    joint = values.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    # Most components are one value, so what is grouped here is hardly more than the linked ones.
    least = joint.groupBy("component").agg(F.min("least").alias("component_id"))
    known = joint.join(least, "component").select("fp", "component_id")
    named = fps.join(known, "fp", "left")
    return named.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
