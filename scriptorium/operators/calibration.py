"""How well signals without ground truth follow the error rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import stats
from scriptorium.functions.metrics import agreement
from scriptorium.operators.pairing import one_to_one, unordered_pairs
from scriptorium.schemas import CELL_KEYS, PAGE_KEYS


def page_agreement(transcriptions: DataFrame, cell: str = "cell", text: str = "text", keys: tuple[str, ...] = PAGE_KEYS) -> DataFrame:
    """Mean gestalt similarity over all pairs of cells of a page, in the order of the cells' names. Pages with a single cell have none.

    Texts meet by page, so a page's pairs are made where its texts are."""
    pairs = unordered_pairs(transcriptions, keys, cell, text)
    scored = pairs.select(*keys, agreement(f"{text}_a", f"{text}_b").alias("similarity"))
    return scored.groupBy(*keys).agg(F.avg("similarity").alias("agreement"), F.count("*").alias("n_pairs"))


def page_means(scores: DataFrame, keys: tuple[str, ...] = PAGE_KEYS) -> DataFrame:
    return scores.groupBy(*keys).agg(F.avg("cer").alias("mean_cer"))


def correlations(df: DataFrame, x: str, y: str, name: str, keys: tuple[str, ...] = (), least: int = 5) -> DataFrame:
    """(metric, value): Spearman and Pearson over all rows, and Spearman of each group of ``least`` rows or more. Without variance the value is null."""
    overall = stats.with_ranks(df, x, y).agg(stats.pearson(F.col("rank_x"), F.col("rank_y")).alias("s"), stats.pearson(F.col(x), F.col(y)).alias("p"))
    out = overall.select(F.expr(f"stack(2, 'spearman_{name}', s, 'pearson_{name}', p) as (metric, value)"))
    if keys:
        each = stats.spearman(df, x, y, list(keys), least)
        out = each.select(F.concat_ws("_", F.lit("spearman"), *keys).alias("metric"), F.col("rho").alias("value")).unionByName(out)
    return out


def summary(scores: DataFrame, fluency: DataFrame, agreements: DataFrame) -> DataFrame:
    """The tall table of both calibrations. Scores and ratings must match one to one."""
    rated = one_to_one(scores, fluency.select("book_id", "page_id", *CELL_KEYS, "fluency_rating"))
    first = correlations(rated, "fluency_rating", "cer", "fluency_vs_cer", CELL_KEYS)
    pages = agreements.join(page_means(scores), list(PAGE_KEYS))
    return first.unionByName(correlations(pages, "agreement", "mean_cer", "agreement_vs_mean_cer"))
