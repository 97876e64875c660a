"""An approximate vector index: vectors stored by cell, so that a search reads the folders of a few cells.

Cells are the regions around centroids that k-means finds on a bounded sample; every vector
is then assigned to its nearest centroid and written below its cell's folder.
A search ranks the centroids, reads the nearest cells alone and computes exact cosines there.  With
no number of probes the search is exact: each cell's least cosine to its centroid bounds what the cell can hold, and
cells that cannot reach the k-th best are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vector as V

#: Vectors that the centroids are fitted on: those of the smallest hashes of their ids.
SAMPLE_ROWS = 50_000
ROUNDS = 10
#: Rows of one file within a cell's folder; larger cells are several files and tasks.
FILE_ROWS = 200_000
#: Queries of one cell that meet its rows at once.
QUERY_BLOCK = 8192
#: What float sums may be off by where a bound decides.
_SLACK = 1e-6


@dataclass
class Cells:
    """Centroids of unit length, a row each, and for each cell the rows it holds and its least cosine to the centroid."""

    path: str
    centroids: np.ndarray
    held: np.ndarray
    least: np.ndarray

    def order(self, vector: list[float]) -> np.ndarray:
        """Cells that hold rows, nearest centroid first."""
        cosine = self.centroids @ _units(np.array([vector], np.float64))[0]
        order = np.argsort(-cosine, kind="stable")
        return order[self.held[order] > 0]

    def most(self, vector: list[float]) -> np.ndarray:
        """The largest cosine with the vector that each cell's rows can have."""
        cosine = np.clip(self.centroids @ _units(np.array([vector], np.float64))[0], -1, 1)
        return np.cos(np.maximum(np.arccos(cosine) - np.arccos(np.clip(self.least, -1, 1)), 0)) + _SLACK


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-300)


def _matrix(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), -1) if len(vectors) else flat.reshape(0, 1)


def usable(rows: DataFrame, vector_col: str, dim: int | None = None) -> DataFrame:
    """Rows with a vector that can have a cosine: not null, no null or infinite component, not zero, and of the given dimension."""
    v = F.col(vector_col)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.filter(F.coalesce(good, F.lit(False)) & (F.size(v) == dim if dim else F.lit(True)))


def fit(rows: DataFrame, cells: int, id_col: str = "chunk_id", vector_col: str = "embedding", sample_rows: int = SAMPLE_ROWS, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids by k-means on directions, fitted on at most ``sample_rows`` vectors (the one sample; every row is assigned later).

    The first centroids are spread evenly over the sample; those that lose all their
    vectors stay.  Fewer vectors than cells give as many cells as vectors.
    """
    found = rows.orderBy(F.xxhash64(F.col(id_col)), id_col).select(vector_col).limit(sample_rows).collect()
    if not found:
        return np.zeros((0, 1))
    x = _units(np.array([r[0] for r in found], np.float64))
    centroids = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)]
    for _ in range(rounds):
        near = np.concatenate([(x[low : low + 4096] @ centroids.T).argmax(axis=1) for low in range(0, len(x), 4096)])
        total = np.zeros_like(centroids)
        np.add.at(total, near, x)
        met = np.linalg.norm(total, axis=1) > 1e-12
        centroids[met] = _units(total[met])
    return centroids


def assigned(rows: DataFrame, centroids: np.ndarray, vector_col: str = "embedding") -> DataFrame:
    """Add cell and near, the cosine to its centroid; of equally near centroids the first."""
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    @F.arrow_udf("struct<cell:int,near:double>")
    def assign(vectors: pa.Array) -> pa.Array:
        x, cell, near = _units(_matrix(vectors)), np.zeros(len(vectors), np.int32), np.zeros(len(vectors))
        for low in range(0, len(x), 1024):
            cosine = x[low : low + 1024] @ shared.value.T
            cell[low : low + 1024] = cosine.argmax(axis=1)
            near[low : low + 1024] = cosine.max(axis=1)
        return pa.StructArray.from_arrays([pa.array(cell), pa.array(near)], names=["cell", "near"])

    return rows.withColumn("_a", assign(F.col(vector_col))).withColumns({"cell": F.col("_a.cell"), "near": F.col("_a.near")}).drop("_a")


def build(rows: DataFrame, path: str, cells: int, id_col: str = "chunk_id", vector_col: str = "embedding", sample_rows: int = SAMPLE_ROWS) -> Cells:
    """Write every usable row below its cell's folder at path; columns called cell or near are replaced.

    The dimension is that of the smallest id's vector.  Large cells are dealt to several
    tasks and files, by their share of the rows, so a cell with a third of them is no single task.
    """
    rows = usable(rows.drop("cell", "near"), vector_col)
    first = rows.orderBy(F.col(id_col).asc_nulls_last()).select(F.size(vector_col).alias("n")).limit(1).collect()
    rows = usable(rows, vector_col, first[0].n if first else 1)
    centroids = fit(rows, cells, id_col, vector_col, sample_rows)
    placed = assigned(rows, centroids, vector_col)
    size = placed.groupBy("cell").agg(F.count("*").alias("n")).collect()
    files = F.create_map(*[F.lit(int(x)) for r in size for x in (r.cell, -(-r.n // FILE_ROWS))]) if size else F.create_map(F.lit(0), F.lit(1))
    part = F.pmod(F.xxhash64(F.col(id_col)), F.coalesce(files[F.col("cell")], F.lit(1)))
    placed.withColumn("_part", part).repartition("cell", "_part").drop("_part").write.mode("overwrite").partitionBy("cell").parquet(path)
    return read(rows.sparkSession, path, centroids)


def read(spark: SparkSession, path: str, centroids: np.ndarray) -> Cells:
    """The index at path, with its cells' statistics."""
    held, least = np.zeros(len(centroids), np.int64), np.ones(len(centroids))
    if len(centroids):
        for r in spark.read.parquet(path).groupBy("cell").agg(F.count("*").alias("n"), F.min("near").alias("least")).collect():
            held[r.cell], least[r.cell] = r.n, r.least
    return Cells(path, centroids, held, least)


def of_cells(spark: SparkSession, index: Cells, cells) -> DataFrame:
    """The rows of some cells; only their folders are read."""
    return spark.read.parquet(index.path).filter(F.col("cell").isin([int(c) for c in cells]))


def _scored(rows: DataFrame, vector: list[float], vector_col: str) -> DataFrame:
    return rows.withColumn("score", F.round(V.cosine_to(F.col(vector_col), vector), 9)).filter("score IS NOT NULL")


def search(spark: SparkSession, index: Cells, vector: list[float], k: int, probes: int | None = None, allowed: DataFrame | None = None, on: str = "message_id", id_col: str = "chunk_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows nearest to a vector, with their score: among the ``probes`` nearest cells, or exactly if that is None.

    ``allowed`` restricts rows by semi-join before the top-k; where the probed cells hold too few allowed
    rows, twice as many are probed until k are found or no cell is left.
    Ties go by falling id.  A zero vector finds nothing.
    """
    order = index.order(vector) if len(index.centroids) and any(vector) else np.zeros(0, int)

    def top(cells) -> DataFrame:
        rows = of_cells(spark, index, cells)
        rows = rows if allowed is None else rows.join(allowed.select(on), on, "left_semi")
        return _scored(rows, vector, vector_col).orderBy(F.desc("score"), F.desc(id_col)).limit(k)

    if len(order) == 0:
        return top([-1]) if len(index.centroids) else spark.createDataFrame([], f"{id_col} long, score double")
    n = min(probes or max(1, len(order) // 16), len(order))
    if probes is not None and allowed is None:
        while index.held[order[:n]].sum() < k and n < len(order):
            n = min(2 * n, len(order))
        return top(order[:n])
    while True:
        best = [r.score for r in top(order[:n]).select("score").collect()]
        if len(best) >= k or n == len(order):
            break
        n = min(2 * n, len(order))
    if probes is not None:
        return top(order[:n])
    most = index.most(vector)
    worth = [c for i, c in enumerate(order) if i < n or len(best) < k or most[c] >= best[k - 1]]
    return top(worth)


def _nearest_cells(index: Cells, vector: Column, probes: int) -> Column:
    """The ``probes`` cells whose centroids are nearest to a vector column."""

    @F.arrow_udf("array<int>")
    def nearest(vectors: pa.Array) -> pa.Array:
        v = _units(_matrix(vectors))
        order = [np.argsort(-(v[low : low + 1024] @ index.centroids.T), axis=1, kind="stable")[:, :probes] for low in range(0, len(v), 1024)]
        return pa.array(list(np.concatenate(order).astype(np.int32)) if order else [], pa.list_(pa.int32()))

    return nearest(vector)


def search_many(spark: SparkSession, index: Cells, queries: DataFrame, k: int, probes: int, query_id: str = "query_id", query_col: str = "vector", id_col: str = "chunk_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank) of the k nearest rows of each query among its ``probes`` nearest cells; ties go by falling id.

    Queries meet the rows of their cells in blocks: a cell's rows are dealt to as many parts, and
    the queries that probe it to as many blocks, as keep either small, and each part meets
    each block once.  A block keeps the k best of each query, and only those are shuffled again.
    """
    kind = dict(queries.dtypes)[query_id]
    columns = [F.col(query_id).alias("q"), F.col(query_col).cast("array<double>").alias("v")]
    asked = usable(queries, query_col, index.centroids.shape[1]).select(*columns)
    asked = asked.withColumn("cell", F.explode(_nearest_cells(index, F.col("v"), probes)))
    many = {r.cell: -(-r.n // QUERY_BLOCK) for r in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    parts = {c: int(-(-index.held[c] // FILE_ROWS)) for c in many if index.held[c]}
    if not parts:
        return spark.createDataFrame([], f"{query_id} {kind}, {id_col} long, score double, rank int")
    number = lambda of, default=1: F.coalesce(F.create_map(*[F.lit(int(x)) for cell, n in of.items() for x in (cell, n)])[F.col("cell")], F.lit(default))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))
    left = asked.filter(F.col("cell").isin(list(parts))).select("cell", F.pmod(F.xxhash64("q"), number(many)).alias("block"), upto(number(parts)).alias("part"), "q", "v")
    rows = of_cells(spark, index, parts).select("cell", F.pmod(F.xxhash64(id_col), number(parts)).alias("part"), upto(number(many)).alias("block"), F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("x"))

    def nearest(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out_q, out_id, out_score = [], [], []
        ids = rows["id"].to_numpy()
        x, v = (_units(_matrix(t.combine_chunks() if isinstance(t, pa.ChunkedArray) else t)) for t in (rows["x"], queries["v"]))
        for low in range(0, len(v) if len(x) else 0, 64):
            best = [(ids[:0], np.zeros(0))] * len(v[low : low + 64])
            for at in range(0, len(x), 16_384):
                cosine = np.round(v[low : low + 64] @ x[at : at + 16_384].T, 9)
                for i, row in enumerate(cosine):
                    own, score = np.concatenate([best[i][0], ids[at : at + 16_384]]), np.concatenate([best[i][1], row])
                    if len(score) > k:
                        near = np.flatnonzero(score >= np.partition(score, -k)[-k])
                        near = near[np.lexsort((-own[near], -score[near]))[:k]]
                        own, score = own[near], score[near]
                    best[i] = own, score
            for i, (own, score) in enumerate(best):
                out_q.append(np.full(len(own), low + i))
                out_id.append(own)
                out_score.append(score)
        at = np.concatenate(out_q) if out_q else np.zeros(0, np.int64)
        return pa.table({"q": queries["q"].take(pa.array(at)), "id": np.concatenate(out_id) if out_id else ids[:0], "score": np.concatenate(out_score) if out_score else np.zeros(0)})

    key = ["cell", "part", "block"]
    found = left.groupBy(*key).cogroup(rows.groupBy(*key)).applyInArrow(nearest, f"q {kind}, id long, score double")
    best = W.partitionBy("q").orderBy(F.desc("score"), F.desc("id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select(F.col("q").alias(query_id), F.col("id").alias(id_col), "score", "rank")


def recall(found: DataFrame, truth: DataFrame, query_id: str = "query_id", id_col: str = "chunk_id") -> DataFrame:
    """(query_id, recall): the share of each query's true neighbours that were found."""
    hit = truth.select(query_id, id_col).join(found.select(query_id, id_col, F.lit(1).alias("hit")), [query_id, id_col], "left")
    return hit.groupBy(query_id).agg((F.count("hit") / F.count("*")).alias("recall"))
