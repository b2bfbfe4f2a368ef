"""Statistics with the definitions that the reports rely on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import order


def pearson(x: Column, y: Column) -> Column:
    """Over rows that have both; null for fewer than two or without variance."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


def average_ranks(df: DataFrame, x: str, out: str, keys: list[str] | None = None) -> DataFrame:
    """``df`` with the tie-averaged rank of ``x`` over all rows or within ``keys``; rows without a value go."""
    keys = keys or []
    ranks = order.average_ranks(df, keys, x, out).select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col(x).alias("__v"), out)
    same = F.col(x) == F.col("__v")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return df.join(ranks, same).drop("__v", *(f"__k{i}" for i in range(len(keys))))


def with_ranks(df: DataFrame, x: str, y: str, keys: list[str] | None = None) -> DataFrame:
    """``df`` without rows that lack either value, and tie-averaged ranks rank_x and rank_y within ``keys``."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    return average_ranks(average_ranks(both, x, "rank_x", keys), y, "rank_y", keys)


def spearman(df: DataFrame, x: str, y: str, keys: list[str] | None = None, least: int = 1) -> DataFrame:
    """(keys, n, rho) of each group of ``least`` rows or more."""
    keys = keys or []
    found = with_ranks(df, x, y, keys).groupBy(*keys).agg(F.count("*").alias("n"), pearson(F.col("rank_x"), F.col("rank_y")).alias("rho"))
    return found.filter(F.col("n") >= least)


def weighted(x: Column, n: Column) -> Column:
    """The mean of values that occur so often."""
    return F.sum(x * n) / F.sum(F.when(x.isNotNull(), n))


def mean_ratio(ratio: Column, of: Column) -> Column:
    """The mean of ratios of whole numbers to the whole numbers ``of``, summed in decimals of 26 places: rows in another order give the same mean, and cells with equal ratios have equal ones."""
    part = F.rint(ratio * of).cast("decimal(28,16)") / of.cast("decimal(10,0)")
    return F.sum(part).cast("double") / F.count(part)


def upper_middle(n: Column) -> Column:
    return F.floor(n / 2)


def nine_tenths(n: Column) -> Column:
    return F.least(F.floor(n * F.lit(0.9)), n - 1)


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each column: count, mean, std, min, exact quartiles, max. All columns are read in one pass, their quartiles in another."""

    def of(name: str) -> Column:
        x = F.col(name).cast("double")
        parts = {"count": F.count(x), "mean": F.avg(x), "std": F.stddev_samp(x), "min": F.min(x), "max": F.max(x)}
        return F.struct(F.lit(name).alias("column"), *(c.alias(k) for k, c in parts.items()))

    moments = df.agg(F.array(*(of(name) for name in columns)).alias("rows")).select(F.inline("rows"))
    tall = df.select(F.explode(F.array(*(F.struct(F.lit(name).alias("column"), F.col(name).cast("double").alias("x")) for name in columns))).alias("r")).select("r.*")
    quartiles = order.quantiles(tall, ["column"], "x", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return moments.join(quartiles, "column", "left").select("column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def histogram(df: DataFrame, x: str, bins: int = 20) -> DataFrame:
    """(bin, low, high, n): equal widths over [min, max], the last bin closed; empty bins count 0. A constant column falls into bin 0."""
    value = F.col(x).cast("double")
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    # One row, so the join is with a scalar.
    placed = df.select(value.alias("v")).filter("v is not null").join(F.broadcast(ends))
    number = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)))
    counts = placed.groupBy(number.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = ends.filter("lo is not null").select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / bins
    return every.join(counts, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def wilcoxon(df: DataFrame, x: str, y: str) -> DataFrame:
    """(n, w_plus, w_minus): signed-rank sums of paired differences; zero differences are left out, ties share their rank."""
    d = df.select((F.col(x) - F.col(y)).alias("d")).filter("d <> 0").select("d", F.abs("d").alias("size"))
    ranked = average_ranks(d, "size", "r")
    total = lambda keep: F.coalesce(F.sum(F.when(keep, F.col("r"))), F.lit(0.0))
    return ranked.agg(F.count("*").alias("n"), total(F.col("d") > 0).alias("w_plus"), total(F.col("d") < 0).alias("w_minus"))
