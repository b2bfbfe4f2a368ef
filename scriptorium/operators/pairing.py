"""Joins and set operations between tables of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.schemas import PAGE_KEYS, SCORE_KEYS
from scriptorium.storage import saved

#: Rows of a key on one side that one task joins; and keys that may have more, at most.
HEAVY, MAX_HEAVY = 1_000_000, 10_000


def heavy_keys(left: DataFrame, right: DataFrame, keys: tuple[str, ...], most: int = HEAVY) -> DataFrame | None:
    """(keys, n_left, n_right) of keys with more than ``most`` rows on a side; None if there are none. With very many rows the limit rises, so that there are ``MAX_HEAVY`` of them on each side at most."""
    counted = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    sides = saved(counted(left, "n_left").join(counted(right, "n_right"), list(keys), "full_outer").fillna(0, ["n_left", "n_right"]), "keys")
    totals = sides.agg(F.sum("n_left"), F.sum("n_right"), F.max(F.greatest("n_left", "n_right"))).first()
    limit = max(most, *(-(-(t or 0) // MAX_HEAVY) for t in totals[:2]))
    if (totals[2] or 0) <= limit:
        return None
    return sides.filter(F.greatest("n_left", "n_right") > limit).withColumns({"__left": F.ceil(F.col("n_left") / limit).cast("int"), "__right": F.ceil(F.col("n_right") / limit).cast("int")})


def _dealt(df: DataFrame, heavy: DataFrame, keys: tuple[str, ...], own: str, other: str) -> DataFrame:
    """Rows of heavy keys: each gets one of its side's shares, and is there once for each share of the other side.

    The share is a hash of the row, so that a task that runs again deals the same way."""
    told_apart = [c for c, kind in df.dtypes if "map<" not in kind]  # maps have no hash
    rows = df.join(F.broadcast(heavy.select(*keys, "__left", "__right")), list(keys))
    share = F.pmod(F.xxhash64(*told_apart), F.col(own)).cast("int")
    return rows.withColumn(f"{own}_share", share).withColumn(f"{other}_share", F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("__left", "__right")


def spread_join(left: DataFrame, right: DataFrame, keys: tuple[str, ...], how: str = "inner", most: int = HEAVY) -> DataFrame:
    """An inner or full outer join by ``keys`` that no heavy key holds up: its rows are dealt to shares of ``most`` rows on each side, and every two shares meet in a task of their own.

    Heavy keys are counted first, and are so few that they are broadcast. Null keys meet nothing and aren't heavy. Columns other than the keys must differ in name."""
    heavy = heavy_keys(left.dropna(subset=list(keys)), right.dropna(subset=list(keys)), keys, most)
    if heavy is None:
        return left.join(right, list(keys), how)
    known = F.broadcast(heavy.select(*keys))
    light = left.join(known, list(keys), "left_anti").join(right.join(known, list(keys), "left_anti"), list(keys), how)
    both = heavy.filter((F.col("n_left") > 0) & (F.col("n_right") > 0))
    shares = [*keys, "__left_share", "__right_share"]
    met = _dealt(left, both, keys, "__left", "__right").join(_dealt(right, both, keys, "__right", "__left"), shares).drop("__left_share", "__right_share")
    out = light.unionByName(met)
    if how == "full_outer":
        alone = lambda df, lacks: df.join(F.broadcast(heavy.filter(F.col(lacks) == 0).select(*keys)), list(keys), "left_semi")
        out = out.unionByName(alone(left, "n_right"), allowMissingColumns=True).unionByName(alone(right, "n_left"), allowMissingColumns=True)
    return out


def pair(images: DataFrame, texts: DataFrame, keys: tuple[str, ...] = PAGE_KEYS, most: int = HEAVY) -> DataFrame:
    """Full outer join: every key with the columns of both sides and a reason (missing_text, missing_image) if one lacks."""
    left, right = images.withColumn("__image", F.lit(True)), texts.withColumn("__text", F.lit(True))
    reason = F.when(F.col("__text").isNull(), "missing_text").when(F.col("__image").isNull(), "missing_image")
    return spread_join(left, right, keys, "full_outer", most).withColumn("reason", reason).drop("__image", "__text")


def pairing_counts(images: DataFrame, texts: DataFrame, keys: tuple[str, ...] = PAGE_KEYS) -> DataFrame:
    """(n_paired, n_missing_text, n_missing_image)."""
    reason = F.col("reason")
    paired = pair(images.select(*keys), texts.select(*keys), keys)
    return paired.agg(F.count_if(reason.isNull()).alias("n_paired"), F.count_if(reason == "missing_text").alias("n_missing_text"), F.count_if(reason == "missing_image").alias("n_missing_image"))


def set_comparison(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of either table and the side they are on: both, left or right."""
    sides = a.withColumn("__side", F.lit(1)).unionByName(b.withColumn("__side", F.lit(2)))
    found = sides.groupBy(*a.columns).agg(F.bit_or("__side").alias("__side"))
    return found.withColumn("side", F.when(F.col("__side") == 3, "both").when(F.col("__side") == 1, "left").otherwise("right")).drop("__side")


def with_truth(transcriptions: DataFrame, truth: DataFrame, keys: tuple[str, ...] = PAGE_KEYS, ref: str = "ref", most: int | None = None) -> DataFrame:
    """Transcriptions whose page has a truth that isn't blank. The filter runs before any metric.

    Spark itself splits large partitions of an inner join; with ``most``, keys with more rows are counted and dealt beforehand."""
    real = truth.filter(F.col(ref).rlike(r"\S"))
    return transcriptions.join(real, list(keys), "inner") if most is None else spread_join(transcriptions, real, keys, "inner", most)


def without_truth(transcriptions: DataFrame, truth: DataFrame, keys: tuple[str, ...] = PAGE_KEYS, ref: str = "ref") -> DataFrame:
    """Dropped transcriptions and why: missing_truth or blank_truth."""
    found = transcriptions.join(truth.select(*keys, F.col(ref).alias("__ref"), F.lit(True).alias("__there")), list(keys), "left")
    reason = F.when(F.col("__there").isNull(), "missing_truth").when(~F.coalesce(F.col("__ref").rlike(r"\S"), F.lit(False)), "blank_truth")
    return found.withColumn("reason", reason).drop("__ref", "__there").filter(F.col("reason").isNotNull())


def checked_unique(df: DataFrame, keys: tuple[str, ...], name: str) -> DataFrame:
    """``df``; the query fails if any key occurs twice. The count travels with the rows, so nothing runs apart."""
    twice = df.groupBy(*keys).agg(F.count("*").alias("__times"))
    text = F.concat(F.lit(f"{name}: duplicate key "), F.to_json(F.struct(*keys)))
    ok = F.when(F.col("__times") > 1, F.raise_error(text).cast("boolean")).otherwise(True)
    return df.join(twice.filter(ok), list(keys)).drop("__times")


def one_to_one(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = SCORE_KEYS) -> DataFrame:
    """Inner join that fails on a duplicate key on either side."""
    return checked_unique(left, keys, "left").join(checked_unique(right, keys, "right"), list(keys), "inner")


def with_dimension(facts: DataFrame, dimension: DataFrame, keys: tuple[str, ...] = PAGE_KEYS) -> DataFrame:
    """N:1 inner join; Spark broadcasts the dimension while it is small."""
    return facts.join(dimension, list(keys), "inner")


def with_cost(cells: DataFrame, costs: DataFrame, keys: tuple[str, ...] = ("model", "preprocessing")) -> DataFrame:
    """Left join to a table of costs. An unknown cell costs 0.0, and cost_known tells it from a free one."""
    found = cells.join(costs.withColumn("cost_known", F.lit(True)), list(keys), "left")
    return found.withColumn("cost_per_page", F.coalesce("cost_per_page", F.lit(0.0))).withColumn("cost_known", F.coalesce("cost_known", F.lit(False)))


def pending(work: DataFrame, done: DataFrame, keys: tuple[str, ...] = SCORE_KEYS) -> DataFrame:
    """What the sink doesn't hold yet."""
    return work.join(done.select(*keys).distinct(), list(keys), "left_anti")


def subset(files: DataFrame, chosen: DataFrame, keys: tuple[str, ...] = PAGE_KEYS) -> DataFrame:
    return files.join(chosen.select(*keys).distinct(), list(keys), "left_semi")


def unordered_pairs(df: DataFrame, keys: tuple[str, ...], order: str, value: str) -> DataFrame:
    """All pairs i < j of the rows of a key, in the order of ``order``. The rows of a key are few (its cells)."""
    side = lambda i: df.select(*keys, F.col(order).alias(f"{order}_{i}"), F.col(value).alias(f"{value}_{i}"))
    return side("a").join(side("b"), list(keys)).filter(F.col(f"{order}_a") < F.col(f"{order}_b"))


def output_collisions(files: DataFrame, output: str = "output_path", source: str = "input_path") -> DataFrame:
    """Of inputs that write to one output, the first is kept and the others fail: adds status (kept, collision)."""
    first = files.groupBy(output).agg(F.min(source).alias("__first"))
    return files.join(first, output).withColumn("status", F.when(F.col(source) == F.col("__first"), "kept").otherwise("collision")).drop("__first")


def target_names(names: DataFrame, name: str = "name") -> DataFrame:
    """Names without leading dots, and whether the target is empty or taken by another name."""
    target = F.regexp_replace(F.col(name), r"^\.+", "")
    counted = names.select(name, target.alias("target"))
    times = counted.groupBy("target").agg(F.countDistinct(name).alias("__n"))
    status = F.when(F.col("target") == "", "empty").when(F.col("__n") > 1, "collision").when(F.col("target") != F.col(name), "rename").otherwise("unchanged")
    return counted.join(times, "target").select(name, "target", status.alias("status"))
