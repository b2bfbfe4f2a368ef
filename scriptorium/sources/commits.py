"""Tables that grow by whole commits: a run that breaks off leaves nothing that a reader sees.

Tasks write Parquet files of names that no one knows yet. The driver's commit writes one small file,
``_commits/<number>``, that lists them, by a rename that fails if the number is taken; a table is what
its commits list. A task that dies, a run that is aborted and a driver that is killed between tasks and
commit leave files which no commit names. Two writers that start from the same number can't both
commit; the second one looks again what the table holds (:func:`append_new`). The folder must be one in
which a file can be made only if it isn't there, as local and shared POSIX folders are.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from scriptorium.operators.pairing import pending
from scriptorium.schemas import SCORE_KEYS


def _folder(path: str) -> str:
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"{path}: commits need a folder of the file system")
    return os.path.abspath(path.removeprefix("file://"))


def committed(path: str) -> tuple[int, list[str]]:
    """(number of the next commit, files that the commits so far list)."""
    folder = os.path.join(_folder(path), "_commits")
    names = sorted(int(n) for n in os.listdir(folder) if n.isdigit()) if os.path.isdir(folder) else []
    files = []
    for name in names:
        with open(os.path.join(folder, str(name)), encoding="utf-8") as file:
            files += json.load(file)
    return (names[-1] + 1 if names else 0), files


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of all commits; no rows if there are none."""
    files = committed(path)[1]
    return spark.read.schema(schema).parquet(*(f"file://{os.path.join(_folder(path), f)}" for f in files)) if files else spark.createDataFrame([], schema)


class Taken(RuntimeError):
    """Another writer committed first."""


@dataclass
class Written(WriterCommitMessage):
    files: list


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, number: int):
        self.path, self.number = _folder(path), number

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        name, file = f"part-{uuid.uuid4().hex}.parquet", None
        for batch in iterator:
            if file is None:
                os.makedirs(self.path, exist_ok=True)
                file = pq.ParquetWriter(os.path.join(self.path, name), batch.schema)
            file.write_batch(batch)
        if file is None:
            return Written([])
        file.close()
        return Written([name])

    def commit(self, messages: list) -> None:
        files = [f for m in messages if m is not None for f in m.files]
        folder = os.path.join(self.path, "_commits")
        os.makedirs(folder, exist_ok=True)
        ready = os.path.join(folder, f"{uuid.uuid4().hex}.ready")
        with open(ready, "w", encoding="utf-8") as file:
            json.dump(files, file)
            file.flush()
            os.fsync(file.fileno())
        try:
            os.link(ready, os.path.join(folder, str(self.number)))
        except FileExistsError:
            self.abort(messages)
            raise Taken(f"commit {self.number} of {self.path} was taken by another writer") from None
        finally:
            os.unlink(ready)

    def abort(self, messages: list) -> None:
        for name in [f for m in messages if m is not None for f in m.files]:
            try:
                os.unlink(os.path.join(self.path, name))
            except FileNotFoundError:
                continue


class CommittedTable(DataSource):
    """``df.write.format("committed").mode("append").option("number", n).save(path)``"""

    @classmethod
    def name(cls) -> str:
        return "committed"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("commits can only be appended")
        return Writer(self.options["path"], int(self.options["number"]))


def append(df: DataFrame, path: str, number: int | None = None) -> None:
    """One commit of the rows of ``df``; fails with :class:`Taken` in its text if ``number`` (the next one) was taken meanwhile."""
    df.sparkSession.dataSource.register(CommittedTable)
    df.write.format("committed").mode("append").option("number", committed(path)[0] if number is None else number).save(path)


def append_new(df: DataFrame, path: str, keys: tuple[str, ...] = SCORE_KEYS, attempts: int = 5) -> None:
    """One commit of the first row of each key that the table lacks. What another writer committed meanwhile is looked at again, so no key is there twice."""
    for attempt in range(attempts):
        number, _ = committed(path)
        try:
            append(pending(df.dropDuplicates(list(keys)), read(df.sparkSession, path, df.schema), keys), path, number)
            return
        except Exception as error:
            if "was taken by another writer" not in str(error) or attempt == attempts - 1:
                raise
