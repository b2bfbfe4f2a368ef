"""Scores that arrive as files: each key is taken once, and the run ends when nothing is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from scriptorium.schemas import SCORE, SCORE_KEYS


def read_scores(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(SCORE).option("header", "true").option("maxFilesPerTrigger", files_per_trigger).csv(path)


def append_once(stream: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = SCORE_KEYS) -> StreamingQuery:
    """Append the first row of each key to a Parquet table and stop after what is there. The keys seen are the stream's state, so a restart repeats nothing.

    The state grows with the keys, for ever; rows with a time go to :func:`append_recent`, and :func:`append_missing` reads the table instead."""
    return stream.dropDuplicates(list(keys)).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def append_recent(stream: DataFrame, path: str, checkpoint: str, at: str, delay: str, keys: tuple[str, ...] = SCORE_KEYS, available_now: bool = True) -> StreamingQuery:
    """Append the first row of each key, for streams whose rows have a time (``at``): a key is known for ``delay`` after its row, by the stream's own time, and then forgotten.

    The state holds keys of the last ``delay`` only. A key that comes again later counts as new, and a row that is older than the stream's time by more than ``delay`` is dropped, as Spark does with late rows."""
    once = stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(list(keys))
    writer = once.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def append_missing(stream: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = SCORE_KEYS) -> StreamingQuery:
    """Per batch, append the rows whose keys the table lacks, the first of each; for sinks that other jobs write too. No state is kept between batches."""

    def run(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
        fresh = batch.dropDuplicates(list(keys))
        if there:
            fresh = fresh.join(spark.read.schema(batch.schema).parquet(path).select(*keys), list(keys), "left_anti")
        fresh.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
