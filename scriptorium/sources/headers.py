"""A data source of corpus files that reads headers instead of images.

The driver lists the books, that is, the top folders; each task walks some of them, and of an image it
only reads the ranges of bytes that hold its size. Files are reached by ``pyarrow.fs``, so a root is a
local path or an address of a store that Arrow knows.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

IMAGE_EXTENSIONS, TEXT_EXTENSION = (".jpg", ".jpeg", ".png"), ".txt"
#: Bytes that are fetched at once.
FETCH = 4096
SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("relative", T.StringType()), ("book_id", T.StringType()), ("page_id", T.StringType()), ("extension", T.StringType()), ("length", T.LongType()), ("width", T.IntegerType()), ("height", T.IntegerType()), ("bytes_read", T.LongType()))])


class Ranges:
    """Bytes of a file by offset, fetched in small ranges; ``total`` is how many came."""

    def __init__(self, fetch: Callable[[int, int], bytes]):
        self.fetch, self.start, self.held, self.total = fetch, 0, b"", 0

    def at(self, offset: int, n: int) -> bytes:
        if not self.start <= offset <= offset + n <= self.start + len(self.held):
            self.start, self.held = offset, self.fetch(max(n, FETCH), offset)
            self.total += len(self.held)
        return self.held[offset - self.start : offset - self.start + n]


def image_size(head: bytes | Ranges | None) -> tuple[int, int] | None:
    """(width, height) of a PNG or JPEG; None if it isn't one. Sizes are in the header, so nothing is decoded; of a JPEG, segments before the size are jumped over."""
    if head is None:
        return None
    read = head.at if isinstance(head, Ranges) else (lambda at, n: head[at : at + n])
    begin = read(0, 24)
    if begin[:8] == b"\x89PNG\r\n\x1a\n" and len(begin) == 24:
        return struct.unpack(">II", begin[16:24])
    if begin[:2] != b"\xff\xd8":
        return None
    at = 2
    while len(segment := read(at, 9)) == 9:
        if segment[0] != 0xFF:
            return None
        marker = segment[1]
        if marker == 0xFF:  # fill byte
            at += 1
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", segment[5:9])
            return width, height
        elif marker in (0x01, *range(0xD0, 0xD9)):  # markers without a length
            at += 2
        else:
            at += 2 + struct.unpack(">H", segment[2:4])[0]
    return None


class Books(InputPartition):
    def __init__(self, folders: list[str]):
        self.folders = folders


class Reader(DataSourceReader):
    def __init__(self, options):
        self.root, self.tasks = options["path"], int(options.get("tasks", 32))

    def _store(self):
        from pyarrow import fs

        root = self.root if "://" in self.root else os.path.abspath(self.root.removeprefix("file:"))
        return fs.FileSystem.from_uri(root)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = self._store()
        books = sorted(i.path for i in store.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.Directory and not i.base_name.startswith("."))
        return [Books(books[k :: self.tasks]) for k in range(min(self.tasks, max(1, len(books))))]

    def read(self, partition: Books) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = self._store()
        prefix, rows = len(root.rstrip("/")) + 1, []
        for book in partition.folders:
            for info in store.get_file_info(fs.FileSelector(book, recursive=True)):
                relative = info.path[prefix:]
                if info.type != fs.FileType.File or any(part.startswith(".") for part in relative.split("/")):
                    continue
                name, dot, extension = info.base_name.rpartition(".")
                name, extension = (name, f".{extension.lower()}") if dot and name else (info.base_name, "")
                size, read = None, 0
                if extension in IMAGE_EXTENSIONS:
                    with store.open_input_file(info.path) as file:
                        ranges = Ranges(lambda n, offset, file=file: file.read_at(n, offset))
                        size, read = image_size(ranges), ranges.total
                rows.append((relative, relative.partition("/")[0], name, extension, info.size, *(size or (None, None)), read))
                if len(rows) == 10_000:
                    yield _batch(rows)
                    rows = []
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=SCHEMA.names)


class CorpusFiles(DataSource):
    """``spark.read.format("corpus_files").load(root)``: files below the books of ``root``, with the sizes of images. Hidden files and folders, and files at the root, don't count."""

    @classmethod
    def name(cls) -> str:
        return "corpus_files"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return Reader(self.options)


def scan(spark: SparkSession, root: str, tasks: int | None = None) -> DataFrame:
    """The files of ``root``; a root that doesn't exist fails."""
    spark.dataSource.register(CorpusFiles)
    return spark.read.format("corpus_files").option("tasks", tasks or 4 * spark.sparkContext.defaultParallelism).load(root)
