"""The matrix of models and preprocessing variants: scores, summaries, pivots and cost."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions import metrics, order, stats
from scriptorium.functions.text import nfc
from scriptorium.operators.pairing import with_cost, with_truth
from scriptorium.schemas import CELL_KEYS, SCORE_KEYS
from scriptorium.storage import saved

#: Variants in the order of the ablation, and USD per page of the cells that have a price.
VARIANT_ORDER = ("raw", "deskew_only", "grayscale_soft", "all_4_stages", "preprocessed")
COST_PER_PAGE = (
    ("claude", "raw", 0.018),
    ("claude", "preprocessed", 0.018),
    ("claude", "opus_raw", 0.13),
    ("claude", "opus_preprocessed", 0.13),
    ("gemini", "raw", 0.0004),
    ("gemini", "preprocessed", 0.0004),
    ("tesseract", "raw", 0.0),
    ("tesseract", "preprocessed", 0.0),
)
#: Fixed value: what a free page counts on a logarithmic axis.
COST_FLOOR = 1e-5


def cost_table(spark: SparkSession, rows=COST_PER_PAGE) -> DataFrame:
    return spark.createDataFrame(list(rows), "model string, preprocessing string, cost_per_page double")


def score(transcriptions: DataFrame, truth: DataFrame, ref: str = "ref", hyp: str = "text") -> DataFrame:
    """CER and WER of every transcription whose page has a truth. Texts are normalised once, and spread out before the quadratic part."""
    paired = with_truth(transcriptions, truth, ref=ref).select(*SCORE_KEYS, nfc(F.col(ref)).alias("__ref"), nfc(F.col(hyp)).alias("__hyp"))
    n = max(paired.sparkSession.sparkContext.defaultParallelism * 2, int(paired.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    r, h = F.col("__ref"), F.col("__hyp")
    return paired.repartition(n, *SCORE_KEYS).select(*SCORE_KEYS, metrics.cer_of(r, h).alias("cer"), metrics.wer_of(r, h).alias("wer"))


def summarize(scores: DataFrame, keys: tuple[str, ...] = CELL_KEYS) -> DataFrame:
    """n, mean, upper median and indexed 90th percentile of CER, mean and upper median of WER."""
    counts = saved(scores.groupBy(*keys, "cer", "wer").agg(F.count("*").alias("times")), "scores")
    means = counts.groupBy(*keys).agg(F.sum("times").alias("n"), stats.weighted(F.col("cer"), F.col("times")).alias("mean_cer"), stats.weighted(F.col("wer"), F.col("times")).alias("mean_wer"))
    cer = order.placed(counts, list(keys), "cer", "times", {"median_cer": stats.upper_middle, "p90_cer": stats.nine_tenths})
    wer = order.placed(counts, list(keys), "wer", "times", {"median_wer": stats.upper_middle})
    found = means.join(cer, list(keys), "left").join(wer, list(keys), "left")
    return found.select(*keys, "n", "mean_cer", "median_cer", "p90_cer", "mean_wer", "median_wer")


def means_and_medians(scores: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, mean_cer, median_cer, n, rows): mean and midpoint median of each cell; ``n`` counts values, ``rows`` all rows. Scores are computed once."""
    counts = saved(scores.groupBy(*keys, "cer").agg(F.count("*").alias("times")), "scores")
    means = counts.groupBy(*keys).agg(stats.weighted(F.col("cer"), F.col("times")).alias("mean_cer"), F.coalesce(F.sum(F.when(F.col("cer").isNotNull(), F.col("times"))), F.lit(0)).alias("n"), F.sum("times").alias("rows"))
    return means.join(order.quantiles(counts, list(keys), "cer", {"median_cer": 0.5}, "times"), list(keys), "left").select(*keys, "mean_cer", "median_cer", "n", "rows")


def mean_median(scores: DataFrame, keys: tuple[str, ...] = CELL_KEYS) -> DataFrame:
    """Mean, midpoint median and count, and the place of each cell by its mean."""
    found = means_and_medians(scores, keys).drop("rows")
    # Cells are few.
    return found.withColumn("place", F.row_number().over(Window.orderBy("mean_cer", *keys)))


def ablation(scores: DataFrame, variants: tuple[str, ...] = VARIANT_ORDER) -> DataFrame:
    """Every model with every variant in order; cells that don't exist are null. Means above 1 are clipped for the plot and flagged."""
    spark = scores.sparkSession
    found = means_and_medians(scores.filter(F.col("preprocessing").isin(*variants)), ("model", "preprocessing")).select("model", "preprocessing", "mean_cer", "median_cer", F.col("rows").alias("n"))
    wanted = spark.createDataFrame([(i, v) for i, v in enumerate(variants)], "variant_order int, preprocessing string")
    models = found.select("model").distinct()
    every = models.select("model", F.explode(F.array(*(F.lit(v) for v in variants))).alias("preprocessing")).join(F.broadcast(wanted), "preprocessing")
    return every.join(found, ["model", "preprocessing"], "left").select("model", "preprocessing", "variant_order", "mean_cer", "median_cer", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("mean_cer").isNotNull(), F.least("mean_cer", F.lit(1.0))).alias("plotted"), (F.col("mean_cer") > 1).alias("clipped"))


def cost_quality(scores: DataFrame, costs: DataFrame) -> DataFrame:
    """Mean CER and cost of each cell, the cost's floor on a log axis, and the place by (cost, mean)."""
    cells = with_cost(scores.groupBy(*CELL_KEYS).agg(F.avg("cer").alias("mean_cer")), costs)
    shown = F.when(F.col("cost_per_page") > 0, F.col("cost_per_page")).otherwise(COST_FLOOR)
    return cells.withColumn("shown_cost", shown).withColumn("place", F.row_number().over(Window.orderBy("cost_per_page", "mean_cer", *CELL_KEYS)))


def bucket_pivot(scores: DataFrame, buckets: DataFrame, names: list[str], bucket: str = "quality_bucket") -> DataFrame:
    """Mean CER of each model by bucket, a column for each of ``names``."""
    return scores.join(buckets, ["book_id", "page_id"]).groupBy("model").pivot(bucket, names).agg(F.avg("cer"))


def capped(scores: DataFrame, keys: tuple[str, ...] = CELL_KEYS) -> DataFrame:
    """Mean with and without values above 1 capped, and how many there are."""
    return scores.groupBy(*keys).agg(F.avg("cer").alias("mean_cer"), F.avg(F.least("cer", F.lit(1.0))).alias("capped_mean_cer"), F.count_if(F.col("cer") > 1).alias("n_outliers"), (F.avg("cer") - F.avg(F.least("cer", F.lit(1.0)))).alias("delta"))


def cost_per_point(cells: DataFrame, baseline: tuple[str, str]) -> DataFrame:
    """Cost over the CER that a cell gains on the baseline cell; null where it gains nothing.

    ``cells`` is evaluated once: means summed again, in another order of rows, differ in their last digits, and the baseline would gain on itself."""
    is_base = (F.col("model") == baseline[0]) & (F.col("preprocessing") == baseline[1])
    # Cells are few.
    base = F.max(F.when(is_base, F.col("mean_cer"))).over(Window.partitionBy())
    gain = F.col("baseline_cer") - F.col("mean_cer")
    return cells.withColumn("baseline_cer", base).withColumn("cost_per_point", F.when(gain > 0, F.col("cost_per_page") / gain)).drop("baseline_cer")


def extrapolate(cells: DataFrame, pages: int, workers: int, latency: str = "latency_s", cost: str = "cost_per_page") -> DataFrame:
    """Cost and hours of ``pages`` pages, with one worker and with several."""
    hours = F.col(latency) * pages / 3600
    return cells.withColumn("total_cost", F.col(cost) * pages).withColumn("hours_sequential", hours).withColumn("hours_parallel", hours / workers)


def weighted_mean(scores: DataFrame, prevalence: DataFrame, stratum: str, weight: str = "weight", keys: tuple[str, ...] = ("model",)) -> DataFrame:
    """Mean CER of each stratum weighted by its share of the corpus."""
    means = scores.groupBy(*keys, stratum).agg(F.avg("cer").alias("mean_cer"))
    w = F.col(weight)
    return means.join(prevalence, stratum).groupBy(*keys).agg((F.sum(w * F.col("mean_cer")) / F.sum(w)).alias("weighted_cer"))


def category_shares(counts: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Each cell's categories as shares of its total, a column each; a cell without edits has 0."""
    wide = counts.groupBy(*CELL_KEYS).pivot("category", list(names)).agg(F.sum("count"))
    filled = [F.coalesce(F.col(n), F.lit(0)) for n in names]
    total = reduce(Column.__add__, filled)
    return wide.select(*CELL_KEYS, total.alias("total"), *(F.coalesce(F.try_divide(c, total), F.lit(0.0)).alias(n) for c, n in zip(filled, names, strict=True)))


def top_categories(counts: DataFrame, names: tuple[str, ...], k: int = 3) -> DataFrame:
    """The ``k`` largest categories of each cell by share; ties keep the order of ``names``."""
    order = F.array_position(F.array(*(F.lit(n) for n in names)), F.col("category"))
    totals = Window.partitionBy(*CELL_KEYS)
    shares = counts.withColumn("share", F.coalesce(F.try_divide(F.col("count").cast("double"), F.sum("count").over(totals)), F.lit(0.0)))
    return shares.withColumn("place", F.row_number().over(totals.orderBy(F.desc("share"), order))).filter(F.col("place") <= k).select(*CELL_KEYS, "place", "category", "share")


def reordered(df: DataFrame, column: str, wanted: tuple[str, ...]) -> DataFrame:
    """Rows in the given order of ``column`` (position), with null rows for values that lack."""
    places = df.sparkSession.createDataFrame([(i, v) for i, v in enumerate(wanted)], f"position int, {column} string")
    return places.join(df, column, "left")
