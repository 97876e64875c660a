"""A content-addressed store of files: each content once, under its own digest, however often and by however many tasks it is written.

A file's place is its digest, so writing it again can only write the same bytes.  Tasks write beside
the place and move the whole file there; one that is there already is left alone.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def place(sha256: str) -> str:
    """Where a digest's file is below the store."""
    return f"{sha256[:2]}/{sha256[2:4]}/{sha256}"


def _system(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def store(contents: DataFrame, root: str, content_col: str = "content") -> DataFrame:
    """Store contents; gives (sha256, path, size_bytes) of what is stored, a row a digest.

    root is a path or URI that all executors reach.  Null contents are left out; an empty one is a file like others.
    Nothing is shuffled but digests.  Files are written when the result is first used.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _system(root)
        for batch in batches:
            rows = {}
            for value in batch.column(0):
                data = value.as_py()
                if data is None or (digest := hashlib.sha256(data).hexdigest()) in rows:
                    continue
                rows[digest] = len(data)
                target = f"{base}/{place(digest)}"
                if system.get_file_info(target).type == fs.FileType.File:
                    continue
                system.create_dir(target.rpartition("/")[0], recursive=True)
                half = f"{target}.{uuid.uuid4().hex}.part"
                with system.open_output_stream(half) as out:
                    out.write(data)
                system.move(half, target)
            found = list(rows)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([place(d) for d in found], pa.string()), pa.array(list(rows.values()), pa.int64())], names=["sha256", "path", "size_bytes"])

    stored = contents.select(content_col).mapInArrow(write, "sha256 string, path string, size_bytes long")
    return stored.groupBy("sha256").agg(F.first("path").alias("path"), F.first("size_bytes").alias("size_bytes"))


def stored(spark: SparkSession, root: str) -> DataFrame:
    """(sha256, path, content, size_bytes) of the whole files in a store, but for the empty one, which Spark does not list; files that were being written when a task died are no part of it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = F.element_at(F.split("path", "/"), -1)
    return files.filter(name.rlike("^[0-9a-f]{64}$")).select(name.alias("sha256"), "path", "content", F.col("length").alias("size_bytes"))


def with_files(blobs: DataFrame, files: DataFrame) -> DataFrame:
    """Blobs (sha256, ...) with content, and state: ok, missing (no file), or corrupt (the content has another digest)."""
    found = blobs.join(files.select("sha256", "content", F.sha2("content", 256).alias("_own")), "sha256", "left")
    empty = F.col("sha256") == hashlib.sha256(b"").hexdigest()
    found = found.withColumns({"content": F.when(empty, F.lit(b"")).otherwise(F.col("content")), "_own": F.when(empty, F.col("sha256")).otherwise(F.col("_own"))})
    state = F.when(F.col("_own").isNull(), "missing").when(F.col("_own") != F.col("sha256"), "corrupt").otherwise("ok")
    return found.withColumn("state", state).drop("_own")
