"""Order statistics of groups of any size: ranks, values at places, interpolated quantiles.

Distinct values are counted first, then dealt to ranges of (group, value), so that a group of any size
is spread over as many tasks as it needs, and groups of a few values share one. What stands before a
range is the sum of its group's ranges before it, of which there are few. A value at a place is only
looked for in the range that holds the place.

Nulls aren't counted; a group with nothing else has size 0, no ranks and null values. Keys may be null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.storage import saved

GROUP, VALUE, TIMES, RANGE, ROWS, BEFORE, SIZE = "__group", "__value", "__times", "__range", "__rows", "__before", "__size"


def counted(rows: DataFrame, keys: list[str], x: str, n: str | None = None, ranges: int | None = None) -> DataFrame:
    """(group, value, times, range): distinct values of each group, in as many ranges as there are shuffle partitions; saved, so that ranges stay what they are.

    ``n``: how many equal rows a row stands for."""
    group = F.struct(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys))) if keys else F.struct(F.lit(0).alias("k"))
    times = F.col(n) if n else F.lit(1)
    tallied = rows.groupBy(group.alias(GROUP), F.col(x).alias(VALUE)).agg(F.sum(F.when(F.col(x).isNotNull(), times).otherwise(0)).cast("long").alias(TIMES))
    ranges = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return saved(tallied.repartitionByRange(ranges, GROUP, VALUE).withColumn(RANGE, F.spark_partition_id()), "order")


def ranges_of(table: DataFrame) -> DataFrame:
    """(group, range, rows, before, size): a row for each range of each group."""
    totals = table.groupBy(GROUP, RANGE).agg(F.sum(TIMES).alias(ROWS))
    group = Window.partitionBy(GROUP)
    return totals.select(GROUP, RANGE, ROWS, (F.sum(ROWS).over(group.orderBy(RANGE)) - F.col(ROWS)).alias(BEFORE), F.sum(ROWS).over(group).alias(SIZE))


def _upto() -> Column:
    """How many of its group's rows are up to a value, itself included."""
    return F.col(BEFORE) + F.sum(TIMES).over(Window.partitionBy(GROUP, RANGE).orderBy(VALUE))


def _named(keys: list[str]) -> list[Column]:
    return [F.col(GROUP)[f"k{i}"].alias(k) for i, k in enumerate(keys)]


def average_ranks(rows: DataFrame, keys: list[str], x: str, out: str, ranges: int | None = None) -> DataFrame:
    """(keys, x, out): the tie-averaged rank of each distinct value within its group."""
    table = counted(rows, keys, x, None, ranges)
    run = table.join(ranges_of(table), [GROUP, RANGE]).select(GROUP, VALUE, TIMES, _upto().alias("__upto"))
    return run.filter(F.col(VALUE).isNotNull()).select(*_named(keys), F.col(VALUE).alias(x), (F.col("__upto") - (F.col(TIMES) - 1) / 2).cast("double").alias(out))


def _at(table: DataFrame, places: list[Callable[[Column], Column]]) -> DataFrame:
    """(group, size, p0, p1 ...): the values at places (from 0) that depend on the size. Only ranges that hold a place are sorted."""
    every = ranges_of(table)
    wanted = [F.when((F.col(BEFORE) <= at(F.col(SIZE))) & (at(F.col(SIZE)) < F.col(BEFORE) + F.col(ROWS)), at(F.col(SIZE))).alias(f"a{i}") for i, at in enumerate(places)]
    names = [f"a{i}" for i in range(len(places))]
    here = every.select(GROUP, RANGE, BEFORE, *wanted).filter(F.coalesce(*names).isNotNull())
    run = table.join(here, [GROUP, RANGE]).withColumn("__upto", _upto())
    values = run.groupBy(GROUP).agg(*(F.max(F.when((F.col("__upto") - F.col(TIMES) <= F.col(a)) & (F.col(a) < F.col("__upto")), F.col(VALUE))).alias(f"p{i}") for i, a in enumerate(names)))
    return every.select(GROUP, SIZE).distinct().join(values, GROUP, "left")


def placed(rows: DataFrame, keys: list[str], x: str, n: str | None, places: dict[str, Callable[[Column], Column]], ranges: int | None = None) -> DataFrame:
    """(keys, name ...): the value at each place of a group's values in order; a place is a function of their number."""
    found = _at(counted(rows, keys, x, n, ranges), list(places.values()))
    return found.select(*_named(keys), *(F.col(f"p{i}").alias(name) for i, name in enumerate(places)))


def interpolated(table: DataFrame, quantiles: list[float]) -> DataFrame:
    """(group, size, q0, q1 ...): quantiles of what ``counted`` gives, linear between the two nearest values."""
    position = lambda size, q: (size - 1) * F.lit(float(q))
    ends = [(lambda size, q=q, near=near: near(position(size, q)).cast("long")) for q in quantiles for near in (F.floor, F.ceil)]
    found = _at(table, ends)

    def between(i: int, q: float) -> Column:
        low, high, at = F.col(f"p{2 * i}").cast("double"), F.col(f"p{2 * i + 1}").cast("double"), position(F.col(SIZE), q)
        return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)

    return found.select(GROUP, SIZE, *(between(i, q).alias(f"q{i}") for i, q in enumerate(quantiles)))


def quantiles(rows: DataFrame, keys: list[str], x: str, wanted: dict[str, float], n: str | None = None, ranges: int | None = None) -> DataFrame:
    """(keys, name ...): interpolated quantiles of each group."""
    found = interpolated(counted(rows, keys, x, n, ranges), list(wanted.values()))
    return found.select(*_named(keys), *(F.col(f"q{i}").alias(name) for i, name in enumerate(wanted)))


def five_numbers(rows: DataFrame, keys: list[str], x: str, ranges: int | None = None) -> DataFrame:
    """(keys, n, q1, median, q3, whisker_low, whisker_high, n_fliers): interpolated quartiles, whiskers at the last value within 1.5 IQR."""
    table = counted(rows, keys, x, None, ranges)
    quartiles = interpolated(table, [0.25, 0.5, 0.75]).select(GROUP, F.col(SIZE).alias("n"), F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"))
    # Every range gets its group's quartiles, so that rows meet them by range and not by group.
    everywhere = table.select(GROUP, RANGE).distinct().join(quartiles, GROUP)
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = F.col(VALUE).between(F.col("q1") - reach, F.col("q3") + reach)
    ends = [F.min(F.when(inside, F.col(VALUE))).alias("whisker_low"), F.max(F.when(inside, F.col(VALUE))).alias("whisker_high"), F.coalesce(F.sum(F.when(~inside, F.col(TIMES))), F.lit(0)).alias("n_fliers")]
    found = table.join(everywhere, [GROUP, RANGE]).groupBy(GROUP, "n", "q1", "median", "q3").agg(*ends)
    return found.select(*_named(keys), "n", "q1", "median", "q3", "whisker_low", "whisker_high", "n_fliers")


def chosen(rows: DataFrame, group: str, at: str, places: DataFrame, ranges: int | None = None) -> DataFrame:
    """(group, at): of each group's distinct values in order, those at the places (from 0) in ``places`` (group, place). Only ranges that hold one are sorted."""
    table = counted(rows, [group], at, None, ranges)
    asked = places.select(F.struct(F.col(group).alias("k0")).alias(GROUP), "place")
    hits = ranges_of(table).join(asked, GROUP).filter((F.col(BEFORE) <= F.col("place")) & (F.col("place") < F.col(BEFORE) + F.col(ROWS)))
    here = hits.groupBy(GROUP, RANGE, BEFORE).agg(F.collect_set("place").alias("__places"))
    run = table.join(here, [GROUP, RANGE]).withColumn("__upto", _upto())
    return run.filter(F.array_contains("__places", F.col("__upto") - 1)).select(F.col(GROUP)["k0"].alias(group), F.col(VALUE).alias(at))
