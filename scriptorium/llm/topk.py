"""Exact top-k search by pivot-table elimination (operator 10).

The pivot table holds each vector's Euclidean distances to ``PIVOTS`` pivots. For a query q and a
candidate x, the largest |d(q,p) - d(x,p)| over the pivots is a lower bound of d(q,x), and since
q.x = (|q|^2 + |x|^2 - d(q,x)^2) / 2, it is also an upper bound of the inner product. Candidates are
evaluated by falling bound, and the search ends when the next bound is below the k-th best score:
nothing that is left can enter, not even by a tie.

Pivots are chosen farthest-first from a sample of ``PIVOT_SAMPLE`` vectors at most, and a query's k-th
best score over that sample is a floor of its k-th best over all: whatever is bound below it is ruled
out from the start. Candidates lie in regions, one for each nearest pivot. A region's ranges of pivot
distances and its greatest norm bound every score in it, so a query is sent only to regions that can
hold one of its answers, and the candidates of a region that no query reaches are never shuffled. What
the driver holds (sample, pivots, regions) is bounded by the sample; pivots and floors change how much is
evaluated, never the result. All vectors of a length that the sample misses are evaluated. Within a
region, queries and candidates meet in a grid of cells of bounded size, so no task holds more than a
block of each.

Cases: vectors that are null, empty, or hold null or non-finite components take no part. Vectors of
another length than the query's are not compared with it. Equal scores go to the smaller id. A query
id that occurs more than once is searched once, by its smallest vector; rows with the query's id are
its own, and rows that repeat an id and its vector count once. Null ids take no part. Fewer than k candidates give all of them; no rows give no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.support import arrow_map, bounded_sample, list_array, written

PIVOTS, PIVOT_SAMPLE = 16, 4096
QUERY_BLOCK, CANDIDATE_BLOCK = 2048, 16384
#: The floor of a query about which the sample says nothing.
NO_FLOOR = -(1 << 63)
#: Products are exact in doubles while every partial sum is below this.
EXACT = 2**53


def integer_vectors(df: DataFrame, id_column: str, vector: str, scale: int = 256) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of each component; only rows that take part."""
    v = F.col(vector)
    wide = F.transform(v, lambda x: x.cast("double"))
    usable = v.isNotNull() & (F.size(v) > 0) & F.forall(wide, lambda x: F.coalesce((F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x), F.lit(False))) & F.col(id_column).isNotNull()
    return df.filter(usable).select(F.col(id_column).cast("long").alias("vec_id"), F.transform(wide, lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def choose_pivots(vectors: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first: each pivot is as far from the ones before as any vector."""
    chosen = [vectors[0]]
    near = ((vectors - vectors[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(vectors)) and near.max() > 0:
        chosen.append(vectors[int(near.argmax())])
        near = np.minimum(near, ((vectors - chosen[-1]) ** 2).sum(axis=1))
    return np.array(chosen)


def distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """One pivot at a time, so that memory stays at a few times the vectors'."""
    return np.stack([np.sqrt(((vectors - p) ** 2).sum(axis=1)) for p in pivots], axis=1)


def sampled(vectors: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length that a bounded sample holds: ids and vectors, each row once."""
    rows = bounded_sample(vectors, F.struct("vec_id", "v"), PIVOT_SAMPLE).dropDuplicates(["vec_id", "v"]).orderBy("vec_id", "v").collect()
    by_dim: dict[int, list] = {}
    for row in rows:
        by_dim.setdefault(len(row["v"]), []).append(row)
    return {dim: (np.array([r["vec_id"] for r in part], dtype=np.int64), np.array([r["v"] for r in part], dtype=np.int64)) for dim, part in by_dim.items()}


def pivot_table(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """(vec_id, v, dim, norm, region, to_pivots array<double>): each row's squared length, distances to the pivots of its dimension, and the nearest of them."""

    def run(batches):
        for batch in batches:
            column = batch.column("v")
            sizes = np.diff(column.offsets.to_numpy())
            counts = np.array([len(pivots.get(int(d), ())) for d in sizes], dtype=np.int64)
            table, norm, region = np.empty(int(counts.sum())), np.zeros(len(sizes)), np.zeros(len(sizes), np.int32)
            ends = np.concatenate([[0], np.cumsum(counts)])
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                x = matrix(column.take(pa.array(at)), int(dim)).astype(np.float64)
                norm[at] = (x**2).sum(axis=1)
                if int(dim) in pivots:
                    d = distances(x, pivots[int(dim)])
                    region[at] = d.argmin(axis=1)
                    table[(ends[at][:, None] + np.arange(d.shape[1])).ravel()] = d.ravel()
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), column, pa.array(sizes.astype(np.int32)), pa.array(norm), pa.array(region), list_array(table, counts, pa.float64())], names=["vec_id", "v", "dim", "norm", "region", "to_pivots"])

    return arrow_map(vectors, run, "vec_id long, v array<long>, dim int, norm double, region int, to_pivots array<double>")


@dataclass
class Region:
    """What bounds the scores of a region's candidates, and how many there are."""

    low: np.ndarray
    high: np.ndarray
    norm: float
    rows: int


def regions_of(table: DataFrame) -> dict[tuple[int, int], Region]:
    """The regions of all lengths with pivots; no more than the sample has rows."""
    edge = lambda f: F.array(*(f(F.get("to_pivots", F.lit(p))) for p in range(PIVOTS)))
    rows = table.filter(F.size("to_pivots") > 0).groupBy("dim", "region").agg(edge(F.min).alias("low"), edge(F.max).alias("high"), F.max("norm").alias("norm"), F.count("*").alias("rows"))
    real = lambda xs: np.array([x for x in xs if x is not None])
    return {(r["dim"], r["region"]): Region(real(r["low"]), real(r["high"]), r["norm"], r["rows"]) for r in rows.collect()}


def upper(q_norm, x_norm, lower):
    """The greatest inner product at a distance of ``lower`` or more; rounding of the distances never lowers it."""
    return (q_norm + x_norm - lower * lower) / 2 + 1e-9 * (q_norm + x_norm) + 1


def floors(q: np.ndarray, q_ids: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th best score over the sample's rows with other ids; ``NO_FLOOR`` if there are fewer or doubles can't tell."""
    out = np.full(len(q), NO_FLOOR, dtype=np.int64)
    if len(x) < k:
        return out
    wide, most = x.astype(np.float64), float(np.abs(x.astype(np.float64)).max(initial=0))
    for start in range(0, len(q), 256):
        part = q[start : start + 256].astype(np.float64)
        scores = part @ wide.T
        scores[q_ids[start : start + 256][:, None] == ids] = -np.inf
        kth = np.partition(scores, len(x) - k, axis=1)[:, len(x) - k]
        sure = np.isfinite(kth) & (np.abs(part).max(axis=1) * most * x.shape[1] < EXACT)
        out[start : start + 256][sure] = kth[sure].astype(np.int64)
    return out


def reach(q_table: np.ndarray, q_norm: np.ndarray, floor: np.ndarray, region: Region) -> np.ndarray:
    """Which queries may find an answer in the region."""
    lower = np.maximum(np.maximum(region.low - q_table, q_table - region.high), 0).max(axis=1)
    return upper(q_norm, region.norm, lower) >= floor


def reaching(queries: DataFrame, sample: dict, regions: dict[tuple[int, int], Region], k: int) -> DataFrame:
    """``queries`` with their floor and the regions each has to look at."""
    of_dim: dict[int, list[int]] = {}
    for dim, region in sorted(regions):
        of_dim.setdefault(dim, []).append(region)

    def run(batches):
        for batch in batches:
            sizes, ids = batch.column("dim").to_numpy(), batch.column("vec_id").to_numpy()
            norm = batch.column("norm").to_numpy()
            floor, goes = np.full(len(ids), NO_FLOOR, dtype=np.int64), [[0]] * len(ids)
            for dim in np.unique(sizes):
                if int(dim) not in sample:
                    continue
                at = np.flatnonzero(sizes == dim)
                take = pa.array(at)
                floor[at] = floors(matrix(batch.column("v").take(take), int(dim)), ids[at], *sample[int(dim)], k)
                to_pivots = batch.column("to_pivots").take(take)
                to_pivots = matrix(to_pivots, len(to_pivots[0]))
                own = of_dim[int(dim)]
                near = np.stack([reach(to_pivots, norm[at], floor[at], regions[int(dim), r]) for r in own], axis=1)
                for i, row in zip(at, near, strict=True):
                    goes[i] = [r for r, there in zip(own, row, strict=True) if there]
            columns = [batch.column(c) for c in ("vec_id", "v", "dim", "to_pivots")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(floor), pa.array(goes, type=pa.list_(pa.int32()))], names=["vec_id", "v", "dim", "to_pivots", "floor", "regions"])

    return arrow_map(queries, run, "vec_id long, v array<long>, dim int, to_pivots array<double>, floor long, regions array<int>")


def products(candidates: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles while every partial sum is below 2**53, else in Python's integers, clipped to a long."""
    if len(query) * float(np.abs(candidates).max(initial=0)) * float(np.abs(query).max(initial=0)) < EXACT:
        return (candidates.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    exact = [sum(int(a) * int(b) for a, b in zip(row, query, strict=True)) for row in candidates]
    return np.array([max(-(2**63), min(2**63 - 1, x)) for x in exact], dtype=np.int64)


def search(q: np.ndarray, q_id: int, q_table: np.ndarray, x: np.ndarray, ids: np.ndarray, x_table: np.ndarray, x_norm: np.ndarray, k: int, floor: int = NO_FLOOR) -> tuple[np.ndarray, np.ndarray]:
    """The k best candidates of one query, but for those below ``floor``: ids and scores, by falling score, then id."""
    lower = np.abs(x_table[:, 0] - q_table[0]) if x_table.shape[1] else np.zeros(len(x))
    for p in range(1, x_table.shape[1]):
        np.maximum(lower, np.abs(x_table[:, p] - q_table[p]), out=lower)
    bound = upper(float((q.astype(np.float64) ** 2).sum()), x_norm, lower)
    bound[ids == q_id] = -np.inf
    best_ids, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
    left, step = np.flatnonzero(bound >= floor), 64
    while len(left):
        take = min(step, len(left))
        cut = np.argpartition(-bound[left], take - 1)[:take] if take < len(left) else np.arange(len(left))
        now = left[cut]
        best_ids, best = np.concatenate([best_ids, ids[now]]), np.concatenate([best, products(x[now], q)])
        order = np.lexsort((best_ids, -best))[:k]
        best_ids, best = best_ids[order], best[order]
        rest = np.ones(len(left), bool)
        rest[cut] = False
        left, step = left[rest], step * 4
        left = left[bound[left] >= (best[-1] if len(best) == k else floor)]
    return best_ids, best


def top_k(df: DataFrame, is_query: Column, id_column: str = "vec_id", vector: str = "embedding", k: int = 5) -> DataFrame:
    """The k highest integer inner products of each row for which ``is_query`` holds, over all other rows: (query_id, rank, vec_id, score)."""
    vectors = integer_vectors(df, id_column, vector)
    sample = sampled(vectors)
    pivots = {dim: choose_pivots(x.astype(np.float64), PIVOTS) for dim, (_, x) in sample.items()}
    table = written(pivot_table(vectors, pivots), "pivot-table")
    asking = table.filter(is_query).groupBy("vec_id").agg(F.min(F.struct("v", "dim", "norm", "to_pivots")).alias("x")).select("vec_id", "x.*")
    regions = regions_of(table)
    reached = written(reaching(asking, sample, regions, k), "reaching")
    asked_of = {(r["dim"], r["region"]): r["count"] for r in reached.filter(F.size("to_pivots") > 0).select("dim", F.explode("regions").alias("region")).groupBy("dim", "region").count().collect()}
    # Rows of lengths without pivots are in no region; all of them together bound the cells of each length.
    rare = F.size("to_pivots") == 0
    blocks = lambda n, size: math.ceil(n / size)
    grid = [(dim, region, blocks(asked_of.get((dim, region), 0), QUERY_BLOCK), blocks(x.rows, CANDIDATE_BLOCK)) for (dim, region), x in regions.items()]
    # No more rows than the sample has, so it is broadcast: a shuffle by region would be skewed.
    grid = vectors.sparkSession.createDataFrame(grid, "dim int, region int, down int, across int")
    rest = (F.lit(max(1, blocks(reached.filter(rare).count(), QUERY_BLOCK))), F.lit(max(1, blocks(table.filter(rare).count(), CANDIDATE_BLOCK))))
    sized = lambda df: df.join(F.broadcast(grid), ["dim", "region"], "left").withColumns({"down": F.coalesce("down", rest[0]), "across": F.coalesce("across", rest[1])}).filter(F.col("down") > 0)
    block = lambda n, *of: F.pmod(F.xxhash64(*of), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = sized(reached.withColumn("region", F.explode("regions")).drop("regions")).withColumn("row", block("down", F.col("vec_id"), F.lit(1)))
    asked = asked.select("vec_id", "v", "dim", "to_pivots", "floor", "region", "row", every("across").alias("column"))
    offered = sized(table).withColumn("column", block("across", F.col("vec_id"), F.col("v"), F.lit(2)))
    offered = offered.select("vec_id", "v", "dim", "to_pivots", "norm", "region", "column", every("down").alias("row"))

    def cell(_, left: pa.Table, right: pa.Table) -> pa.Table:
        out = ([], [], [])
        if len(left) and len(right):
            dim = left["dim"][0].as_py()
            x, ids = matrix(right["v"], dim), right["vec_id"].to_numpy()
            n_pivots = len(right["to_pivots"][0])  # none for a length that the sample missed
            table_of = lambda side: matrix(side["to_pivots"], n_pivots) if n_pivots else np.zeros((len(side), 0))
            x_table, x_norm = table_of(right), right["norm"].to_numpy()
            x, ids, x_table, x_norm = _collapsed(x, ids, x_table, x_norm, k)
            q, q_ids, q_table = matrix(left["v"], dim), left["vec_id"].to_numpy(), table_of(left)
            floor = left["floor"].to_numpy()
            for i in range(len(q)):
                found, scores = search(q[i], q_ids[i], q_table[i], x, ids, x_table, x_norm, k, int(floor[i]))
                out[0].append(np.full(len(found), q_ids[i]))
                out[1].append(found)
                out[2].append(scores)
        return pa.table({name: np.concatenate([*a, np.zeros(0, np.int64)]) for name, a in zip(("query_id", "vec_id", "score"), out, strict=True)})

    keys = ["dim", "region", "row", "column"]
    found = asked.groupBy(*keys).cogroup(offered.groupBy(*keys)).applyInArrow(cell, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _collapsed(x, ids, x_table, x_norm, k):
    """Of each set of equal vectors the k + 1 smallest ids: the others lose every tie, the query's own row included."""
    order = np.lexsort((ids, *x.T))
    repeated = (ids[order][1:] == ids[order][:-1]) & (x[order][1:] == x[order][:-1]).all(axis=1)
    order = order[np.concatenate([np.ones(min(1, len(x)), bool), ~repeated])]
    same = np.concatenate([np.zeros(min(1, len(order)), bool), (x[order][1:] == x[order][:-1]).all(axis=1)])
    at = np.arange(len(order))
    keep = order[at - np.maximum.accumulate(np.where(same, 0, at)) <= k]
    return x[keep], ids[keep], x_table[keep], x_norm[keep]
