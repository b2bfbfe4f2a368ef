"""Reproducible samples."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.functions import order
from scriptorium.storage import saved


def keyed_order(seed: int, *keys: Column) -> Column:
    """A pseudo-random order that depends on the seed and the key alone."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") for k in keys)).cast("binary"))


def stratified(df: DataFrame, stratum: str, keys: list[str], per_stratum: int, seed: int = 42, strict: bool = True) -> DataFrame:
    """``per_stratum`` rows of each stratum. With ``strict`` the query fails and lists every stratum that has fewer.

    A first cut by hash leaves each stratum a few times what it needs, so that no stratum is sorted whole; if the cut was too deep for a stratum, its rows are all ranked."""
    order = keyed_order(seed, *(F.col(k) for k in keys))
    sizes = df.groupBy(stratum).agg(F.count("*").alias("__n"))
    short = sizes.agg(F.array_sort(F.collect_list(F.when(F.col("__n") < per_stratum, F.concat_ws(" has ", F.col(stratum).cast("string"), F.col("__n").cast("string"))))).alias("s"))
    # Strata are few; rows are cut before the window by the share that their stratum needs.
    share = F.least(F.lit(1.0), F.lit(float(8 * per_stratum + 200)) / F.col("__n"))
    value = F.conv(F.substring("__order", 1, 8), 16, 10).cast("double") / float(1 << 32)
    placed = df.withColumn("__order", order).join(sizes, stratum)
    left = placed.filter(value <= share).groupBy(stratum).agg(F.count("*").alias("__left"))
    cut = placed.join(left, stratum, "left").filter((value <= share) | (F.coalesce("__left", F.lit(0)) < per_stratum))
    ranked = cut.withColumn("__r", F.row_number().over(Window.partitionBy(stratum).orderBy("__order", *keys))).filter(F.col("__r") <= per_stratum)
    out = ranked.drop("__order", "__n", "__left", "__r")
    if strict:
        failed = F.when(F.size("s") > 0, F.raise_error(F.concat(F.lit(f"fewer than {per_stratum} rows: "), F.array_join("s", ", "))).cast("boolean")).otherwise(True)
        out = out.join(short.filter(failed).select(F.lit(1).alias("__ok")), F.lit(True), "inner").drop("__ok")
    return out.select(*df.columns)


def stratified_exact(df: DataFrame, stratum: str, keys: list[str], per_stratum: int, seed: int = 42) -> DataFrame:
    """The rows that one random.Random(seed) draws over sorted strata, candidates in the order of ``df``, whose rows the keys tell apart.

    What is drawn depends on the strata's sizes alone, so the driver sees a number for each stratum and draws places; rows are found at their places on the executors."""
    spark = df.sparkSession
    numbered = saved(df.select(stratum, *keys).withColumn("__row", F.monotonically_increasing_id()), "numbered")
    sizes = {r[stratum]: r["count"] for r in numbered.groupBy(stratum).count().collect()}
    order_of = sorted(sizes, key=lambda s: (s is not None, s))
    if short := [f"{s} has {sizes[s]}" for s in order_of if sizes[s] < per_stratum]:
        raise ValueError(f"fewer than {per_stratum} rows: " + ", ".join(short))
    rng = random.Random(seed)
    drawn = [(s, place) for s in order_of for place in rng.sample(range(sizes[s]), per_stratum)]
    schema = T.StructType([T.StructField(stratum, df.schema[stratum].dataType), T.StructField("place", T.LongType())])
    found = order.chosen(numbered, stratum, "__row", spark.createDataFrame(drawn, schema))
    wanted = numbered.join(found.select("__row"), "__row", "left_semi").select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return df.join(wanted, same, "left_semi")


def spot_check(df: DataFrame, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement (all, if fewer); a top-k by hash, so no full sort."""
    return df.withColumn("__order", keyed_order(seed, *(F.col(k) for k in keys))).orderBy("__order", *keys).limit(n).drop("__order")


def quantile_strata(df: DataFrame, x: str, keys: list[str], per_stratum: int, strata: int = 5, seed: int = 42) -> DataFrame:
    """A sample of each quantile range of ``x``; ranges are bounded by exact percentiles, which come from counts of values."""
    names = [f"e{i}" for i in range(1, strata)]
    edges = order.quantiles(df, [], x, {n: i / strata for i, n in enumerate(names, 1)}).select(F.array(*names).alias("__edges"))
    number = F.size(F.filter("__edges", lambda e: e < F.col(x))) + 1
    placed = df.join(F.broadcast(edges)).withColumn("stratum", number).drop("__edges")
    return stratified(placed, "stratum", keys, per_stratum, seed, strict=False)


def priority_bucket(df: DataFrame, keys: list[str], bucket: str, order: tuple[str, ...]) -> DataFrame:
    """One bucket for each key: the most severe, ``order`` naming them from the most to the least."""
    rank = F.coalesce(F.array_position(F.array(*(F.lit(b) for b in order)), F.col(bucket)), F.lit(0))
    known = F.when(rank > 0, rank).otherwise(len(order) + 1)
    return df.groupBy(*keys).agg(F.min_by(bucket, F.struct(known, F.col(bucket))).alias(bucket))


def first_n(df: DataFrame, column: str, n: int) -> DataFrame:
    """The first ``n`` distinct values in order."""
    return df.select(column).distinct().orderBy(column).limit(n)
