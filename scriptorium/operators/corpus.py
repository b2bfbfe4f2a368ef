"""Totals, statistics and run counters of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import order


def totals(inventory: DataFrame) -> DataFrame:
    return inventory.agg(F.countDistinct("book_id").alias("n_books"), F.count("*").alias("n_pages"), F.sum("image_bytes").alias("image_bytes"), F.sum("text_bytes").alias("text_bytes"))


def stats_row(inventory: DataFrame) -> DataFrame:
    """The one row of the statistics artefact. mean_text_length_chars is of bytes, as its consumers know it."""
    uniform = F.countDistinct("image_width") == 1
    return inventory.agg(
        F.count("*").alias("n_pages"), F.countDistinct("book_id").alias("n_books"), F.avg("image_width").cast("long").alias("mean_width"), F.median("image_height").cast("long").alias("median_height"),
        uniform.alias("uniform_width"), F.when(uniform, F.min("image_width")).alias("width"), F.avg("text_bytes").alias("mean_text_length_chars"), (F.avg("image_width") / 6.0).alias("dpi_estimate"),
    )


def as_json(row: DataFrame) -> DataFrame:
    """Rows as JSON objects with two spaces of indent."""
    return row.select(F.to_json(F.struct(*row.columns), {"pretty": "true"}).alias("value"))


def pages_per_book(inventory: DataFrame) -> DataFrame:
    """Pages of each book, and of all in a row with a null book."""
    return inventory.rollup("book_id").agg(F.count("*").alias("n_pages"))


def rating_distribution(ratings: DataFrame, rating: str = "fluency_rating") -> DataFrame:
    """Count and percent of each rating, and the mean of all beside it. Ratings are few, so the windows are over few rows."""
    counts = ratings.filter(F.col(rating).isNotNull()).groupBy(rating).agg(F.count("*").alias("n"))
    every = Window.partitionBy()
    n = F.sum("n").over(every)
    return counts.select(rating, "n", (100.0 * F.col("n") / n).alias("percent"), (F.sum(F.col(rating) * F.col("n")).over(every) / n).alias("mean_rating"))


def run_counters(manifest: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """found, processed, skipped, failed."""
    skipped, failed = F.coalesce(F.col("skipped"), F.lit(False)), F.col("error").isNotNull()
    return manifest.groupBy(*keys).agg(F.count("*").alias("found"), F.count_if(~skipped & ~failed).alias("processed"), F.count_if(skipped).alias("skipped"), F.count_if(failed).alias("failed"))


def latency(manifest: DataFrame, keys: tuple[str, ...] = ("model",), column: str = "latency_ms") -> DataFrame:
    """Mean (to one decimal) and median of the rows that have a latency."""
    means = manifest.groupBy(*keys).agg(F.round(F.avg(column), 1).alias("mean_latency"), F.count(column).alias("n"))
    return means.join(order.quantiles(manifest, list(keys), column, {"median_latency": 0.5}), list(keys), "left").select(*keys, "mean_latency", "median_latency", "n")


def slowest(df: DataFrame, column: str, n: int = 10, ties: tuple[str, ...] = ()) -> DataFrame:
    return df.orderBy(F.desc(column), *ties).limit(n)


def latest_of_each(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row for each key."""
    return df.dropDuplicates(list(keys))
