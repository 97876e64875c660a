"""Mbox files as a Spark data source: byte ranges of any file in parallel, folders pruned by the filter, heads without bodies.

``spark.read.format("mboxes").load(path)`` gives (mailbox, position, head, raw, received_at).  A filter on
``mailbox`` (equal, or one of a list) leaves out the other folders' files before anything is read.  With the option
``heads`` only the bytes up to each message's first empty line are kept, however far that is, and ``raw`` is null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

SCHEMA = "mailbox string, position long, head binary, raw binary, received_at timestamp"
#: Bytes of one partition, and of one read.
RANGE_BYTES, READ_BYTES = 64 << 20, 1 << 20
_MARK = b"\nFrom "
_ENVELOPE = re.compile(rb"(\w{3} +\d{1,2} \d{2}:\d{2}:\d{2} \d{4})\s*$")


class Range(InputPartition):
    """A file's messages whose From line starts at or after ``start`` and before ``end``."""

    def __init__(self, path: str, mailbox: str, start: int, end: int):
        super().__init__(None)
        self.path, self.mailbox, self.start, self.end = path, mailbox, start, end


def received(line: bytes) -> datetime | None:
    """UTC time at the end of a From line."""
    found = _ENVELOPE.search(line)
    try:
        return datetime.strptime(b" ".join(found[1].split()).decode(), "%b %d %H:%M:%S %Y").replace(tzinfo=timezone.utc) if found else None
    except ValueError:
        return None


def _messages(source, start: int, end: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(position, bytes from the From line on) of the messages that start in a range; the last one is read to its end, beyond the range."""
    # The line's end before a From line is part of the mark; the file's first line has one made up.
    source.seek(max(start - 1, 0))
    held, open_at, last = b"" if start else b"\n", None, start - 1  # last: file position of held[0]
    scan = 0
    while True:
        more = source.read(min(READ_BYTES, size - (last + len(held)))) if last + len(held) < size else b""
        held += more
        while (mark := held.find(_MARK, scan)) >= 0:
            begin = last + mark + 1
            if open_at is not None:
                yield open_at, held[: mark]
            if begin >= end:
                return
            open_at, held, last, scan = begin, held[mark + 1 :], begin, 0
        if not more:
            if open_at is not None:
                yield open_at, held
            return
        keep = len(_MARK) - 1
        if open_at is not None:
            scan = max(len(held) - keep, 0)
        else:  # nothing but the tail of an earlier message
            last, held = last + max(len(held) - keep, 0), held[-keep:]
            if last >= end:
                return


class MboxReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.options = options["path"], options
        self.heads = options.get("heads", "false").lower() == "true"
        self.range_bytes = int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))
        self.mailboxes: set[str] | None = None

    def pushFilters(self, filters):
        """Filters on the mailbox choose files, and nothing of them is left for Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("mailbox",):
                wanted = set(f.value) if isinstance(f, In) else {f.value}
                self.mailboxes = wanted if self.mailboxes is None else self.mailboxes & wanted
            else:
                yield f

    def partitions(self) -> list[Range]:
        system, root = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        info = system.get_file_info(root)
        files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        out = []
        for f in sorted((f for f in files if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))), key=lambda f: f.path):
            mailbox = f.base_name.removesuffix(".mbox")
            if self.mailboxes is None or mailbox in self.mailboxes:
                out += [Range(f.path, mailbox, low, min(low + self.range_bytes, f.size)) for low in range(0, f.size, self.range_bytes)]
        return out or [Range("", "", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else fs.LocalFileSystem()
        rows: list[tuple] = []
        with system.open_input_file(partition.path) as source:
            held = 0
            for position, data in _messages(source, partition.start, partition.end, source.size()):
                line, _, body = data.partition(b"\n")
                if not body:
                    continue
                body = re.sub(rb"(?m)^>(>*From )", rb"\1", body)
                head = re.split(rb"\r?\n\r?\n", body, maxsplit=1)[0]
                rows.append((partition.mailbox, position, head, None if self.heads else body, received(line)))
                held += len(head) if self.heads else len(head) + len(body)
                if held > 4 << 20:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.timestamp("us", "UTC")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["mailbox", "position", "head", "raw", "received_at"])


class MboxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mboxes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MboxReader:
        return MboxReader(dict(self.options))


def read(spark: SparkSession, path: str, heads: bool = False, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The messages of an mbox file, or of all below a folder; folders are pruned by filters on ``mailbox``."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MboxSource)
    return spark.read.format("mboxes").option("heads", str(heads).lower()).option("rangeBytes", str(range_bytes)).load(path)
