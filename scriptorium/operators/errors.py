"""Where transcriptions go wrong: units of edits by category."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.metrics import BURST, CATEGORIES, edit_categories
from scriptorium.operators.pairing import with_truth
from scriptorium.schemas import CELL_KEYS, PAGE_KEYS


def page_units(transcriptions: DataFrame, truth: DataFrame, ref: str = "ref", hyp: str = "text", burst: int = BURST) -> DataFrame:
    """(book_id, page_id, model, preprocessing, units): a map of units by category for each page. Cells without a preprocessing name are left out."""
    named = transcriptions.filter(F.col("preprocessing") != "unknown")
    paired = with_truth(named, truth, ref=ref).select(*PAGE_KEYS, *CELL_KEYS, F.col(ref).alias("__ref"), F.col(hyp).alias("__hyp"))
    n = max(paired.sparkSession.sparkContext.defaultParallelism * 2, int(paired.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = paired.repartition(n, *PAGE_KEYS, *CELL_KEYS)
    return spread.select(*PAGE_KEYS, *CELL_KEYS, edit_categories(burst)("__ref", "__hyp").alias("units"))


def by_cell(units: DataFrame, names: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """(model, preprocessing, category, count, n_pages), a row for every category of every cell, zeros included."""
    pages = units.groupBy(*CELL_KEYS).agg(F.count("*").alias("n_pages"))
    sums = units.select(*CELL_KEYS, F.explode("units").alias("category", "n")).groupBy(*CELL_KEYS, "category").agg(F.sum("n").alias("count"))
    every = pages.select(*CELL_KEYS, "n_pages", F.explode(F.array(*(F.lit(n) for n in names))).alias("category"))
    return every.join(sums, [*CELL_KEYS, "category"], "left").select(*CELL_KEYS, "category", F.coalesce("count", F.lit(0)).cast("long").alias("count"), "n_pages")


def totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy(*CELL_KEYS).agg(F.sum("count").alias("edits"))
