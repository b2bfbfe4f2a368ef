"""Sinks: sorted CSV, JSON lines, tables of texts and images, single JSON objects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import relative_to
from scriptorium.operators.corpus import as_json
from scriptorium.operators.pairing import output_collisions, pending, subset
from scriptorium.schemas import PAGE_KEYS, SCORE_KEYS


#: Tasks (and files) of one book at most.
BOOK_TASKS = 8


def sorted_csv(df: DataFrame, path: str, order: tuple[str, ...], columns: tuple[str, ...] | None = None, one_file: bool = False, mode: str = "errorifexists") -> None:
    """CSV with a header, in total order over its part files; ``one_file`` for small tables."""
    out = df.select(*columns) if columns else df
    out = out.coalesce(1).sortWithinPartitions(*order) if one_file else out.orderBy(*order)
    out.write.mode(mode).option("header", "true").csv(path)


def inventory_csv(rows: DataFrame, path: str, root: str, **options) -> None:
    """Paths relative to ``root``; those elsewhere stay absolute."""
    made = rows.withColumn("image_path", relative_to(F.col("image_path"), root)).withColumn("text_path", relative_to(F.col("text_path"), root))
    sorted_csv(made, path, PAGE_KEYS, **options)


def mismatch_report(bad: DataFrame, path: str, mode: str = "errorifexists") -> int:
    """JSON lines and their number. An empty report is a file without lines, which tells a clean run from none."""
    # Lines and their number come from one run of the plan: the number is that of the lines written.
    bad.select(F.to_json(F.struct(*bad.columns)).alias("value")).coalesce(1).write.mode(mode).text(path)
    return bad.sparkSession.read.text(path).count()


def score_csv(scores: DataFrame, path: str, **options) -> None:
    sorted_csv(scores, path, ("model", "preprocessing", "book_id", "page_id"), columns=(*SCORE_KEYS, "cer", "wer"), **options)


def eval_csv(chosen: DataFrame, path: str, **options) -> None:
    sorted_csv(chosen, path, ("quality_bucket", "book_id", "page_id"), columns=("book_id", "page_id", "quality_bucket", "has_latin_chars", "image_path", "text_path"), **options)


def append_new(df: DataFrame, done: DataFrame, path: str, keys: tuple[str, ...] = SCORE_KEYS) -> None:
    """Append the rows whose keys the sink lacks; a run that broke off goes on where it was."""
    pending(df, done, keys).write.mode("append").option("header", "true").csv(path)


def manifest(rows: DataFrame, path: str) -> None:
    """JSON lines, rewritten whole; nulls are written, so every line has every key."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def page_texts(transcriptions: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder for each book; a book of many pages is dealt to several tasks."""
    transcriptions.repartition(F.col("book_id"), F.pmod(F.xxhash64("page_id"), F.lit(BOOK_TASKS))).write.mode(mode).partitionBy("book_id").parquet(path)


def images(rows: DataFrame, path: str, output: str = "output_path", source: str = "input_path") -> DataFrame:
    """Write the images that keep their output path and return the collisions, which count as failed."""
    judged = output_collisions(rows, output, source)
    judged.filter("status = 'kept'").drop("status").write.mode("overwrite").parquet(path)
    return judged.filter("status = 'collision'")


def json_object(row: DataFrame, path: str, mode: str = "overwrite") -> None:
    as_json(row).coalesce(1).write.mode(mode).text(path)


def copied_subset(files: DataFrame, chosen: DataFrame, path: str, keys: tuple[str, ...] = PAGE_KEYS) -> None:
    """Files of the chosen pages as a table; a chosen page without files fails the query."""
    lacking = chosen.select(*keys).distinct().join(files.select(*keys).distinct(), list(keys), "left_anti")
    if (missing := lacking.limit(5).collect()) != []:
        raise FileNotFoundError(f"no files for {[tuple(r) for r in missing]}")
    subset(files, chosen, keys).write.mode("overwrite").parquet(path)


def bucketed(df: DataFrame, table: str, keys: tuple[str, ...] = SCORE_KEYS, buckets: int = 64) -> None:
    """Append to a catalog table whose rows lie in buckets by ``keys``, so that resuming never shuffles what is done."""
    df.repartition(buckets, *keys).write.mode("append").format("parquet").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)


def pending_of(work: DataFrame, table: str, keys: tuple[str, ...] = SCORE_KEYS) -> DataFrame:
    """What a table made by :func:`bucketed` doesn't hold yet. Only ``work`` is shuffled, to the table's buckets."""
    done = work.sparkSession.table(table).select(*keys)
    return work.hint("shuffle_merge").join(done.hint("shuffle_merge"), list(keys), "left_anti")
