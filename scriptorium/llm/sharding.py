"""Sharding by extendible hashing (operator 4).

The directory is indexed by the leading bits of a 60-bit key. A bucket that exceeds the byte limit
splits on its next bit; the others stay as they are. ``STEP`` bits are looked at in one pass over a
slim table of keys and sizes, so the number of passes is the depth of the deepest bucket over
``STEP``, and only rows of buckets that are still too large take part in a later pass. Directory and
counts are tables; nothing that grows with the input goes to the driver.

Rows that agree in every key column share all bits of the key. Where such rows alone exceed the limit,
their bucket goes on splitting by the bits of a second hash, of a number that each row gets when the
slim table is written; so the numbers are fixed whatever is computed again.

Cases: a null text has no bytes; a null in a key column counts as empty. Repeated rows are parted as
above. Only a single row above the limit exceeds it: its bucket holds nothing else and ``overflow`` is
true. An empty table gives an empty result. Only the named columns are read, so other columns cannot
clash; ``write_shards`` keeps all columns, whose names must not begin with ``__shard``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.support import written

BITS, STEP = 60, 8
SHARD_BYTES = 16 << 20
#: Bytes of text in a shard of the registered query: its directory has some levels on small tables too.
QUERY_BYTES = 256 << 10
#: Buckets beyond which a semi-join with them isn't broadcast.
MAX_SENT = 250_000


def hash_key(*columns: Column) -> Column:
    """60 leading bits of an MD5 over the columns as text, as a long."""
    joined = F.concat_ws("\x1f", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns))
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def prefix(key: Column, depth: int) -> Column:
    return F.shiftright(key, BITS - depth)


def row_hash() -> Column:
    """``BITS`` bits that differ among repeated rows. Only a written table holds them still."""
    return F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - BITS)


def measured(df: DataFrame, id_column: str, text: str, *more: Column) -> DataFrame:
    """The slim table: n_bytes and key of each row, and ``more``."""
    return written(df.select(F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), hash_key(F.col(id_column), F.col(text)).alias("key"), *more), "keys")


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of so many counted rows of a few numbers each, sent to all tasks unless they are many."""
    return F.broadcast(df) if rows <= MAX_SENT else df


def split(slim: DataFrame, limit: int) -> DataFrame:
    """Directories of ``slim`` (root, key, n_bytes), one for each root: a row (root, prefix, depth, shard_bytes, shard_rows, lo) for each shard, where lo is its least key."""
    sums = (F.sum("n_bytes").alias("b"), F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
    whole = slim.groupBy("root").agg(*sums).select("root", F.lit(0).cast("long").alias("prefix"), F.lit(0).alias("depth"), F.col("b").alias("shard_bytes"), F.col("n").alias("shard_rows"), "lo", (F.col("lo") == F.col("hi")).alias("same"))
    whole = written(whole, "shards0")
    fits = (F.col("shard_bytes") <= limit) | F.col("same")
    leaves, opened, depth = [whole.filter(fits)], whole.filter(~fits), 0
    while depth < BITS and (n_opened := opened.count()):
        to = min(depth + STEP, BITS)
        wanted = few(opened.select("root", F.col("prefix").alias("top")), n_opened)
        rows = slim.withColumn("top", prefix(F.col("key"), depth)).join(wanted, ["root", "top"], "left_semi")
        cells = rows.groupBy("root", "top", prefix(F.col("key"), to).alias("cell")).agg(*sums)
        # All sizes on the way down share one exchange by root and top, which has 2**STEP cells at most.
        for d in range(depth + 1, to + 1):
            w = Window.partitionBy("root", "top", F.shiftright("cell", to - d))
            lo, hi = F.min("lo").over(w), F.max("hi").over(w)
            cells = cells.withColumn(f"at{d}", F.struct("root", F.lit(d).alias("depth"), F.shiftright("cell", to - d).alias("prefix"), F.sum("b").over(w).alias("shard_bytes"), F.sum("n").over(w).alias("shard_rows"), lo.alias("lo"), (lo == hi).alias("same")))
        steps = [F.col(f"at{d}") for d in range(depth + 1, to + 1)]
        ends = [(s["shard_bytes"] <= limit) | s["same"] for s in steps]
        chosen = reduce(lambda rest, x: F.when(x[0], x[1]).otherwise(rest), list(zip(ends, steps))[::-1], steps[-1])
        made = written(cells.select(chosen.alias("at")).distinct().select("at.root", "at.prefix", "at.depth", "at.shard_bytes", "at.shard_rows", "at.lo", "at.same"), f"shards{to}")
        leaves.append(made if to == BITS else made.filter(fits))
        opened, depth = made.filter(~fits), to
    return reduce(DataFrame.unionByName, leaves).drop("same")


def bits() -> Column:
    return F.when(F.col("depth") == 0, "").otherwise(F.expr("lpad(bin(prefix), depth, '0')"))


def first_directory(slim: DataFrame, limit: int) -> tuple[DataFrame, DataFrame, int]:
    """The directory by the key alone; its buckets of repeated rows above the limit, and their number."""
    found = split(slim.select(F.lit(-1).cast("long").alias("root"), "key", "n_bytes"), limit).withColumn("shard", bits())
    crowded = written(found.filter((F.col("shard_bytes") > limit) & (F.col("shard_rows") > 1)), "crowded")
    return found, crowded, crowded.count()


def full_directory(slim: DataFrame, first: DataFrame, crowded: DataFrame, n_crowded: int, limit: int) -> DataFrame:
    """``first`` with its ``crowded`` buckets split by the bits of ``tie``; their root is the key that their rows share."""
    if not n_crowded:
        return first
    base = crowded.select(F.col("lo").alias("root"), F.col("shard").alias("base"))
    rows = written(slim.withColumnRenamed("key", "root").join(few(base.select("root"), n_crowded), "root", "left_semi").select("root", F.col("tie").alias("key"), "n_bytes"), "crowd")
    second = split(rows, limit).join(base, "root").withColumn("shard", F.concat("base", bits())).drop("base")
    return first.filter((F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1)).unionByName(second)


def ways(directory: DataFrame, key: Column, tie: Column) -> Column:
    """All places (root, depth, prefix) where the directory may hold a row; it holds one of them."""
    found = directory.select((F.col("root") >= 0).alias("below"), "depth").distinct().collect()  # 122 at most
    levels = sorted((r["below"], r["depth"]) for r in found) or [(False, 0)]
    return F.explode(F.array(*(F.struct((key if below else F.lit(-1).cast("long")).alias("root"), F.lit(d).alias("depth"), prefix(tie if below else key, d).alias("prefix")) for below, d in levels)))


def shards(df: DataFrame, id_column: str = "doc_id", text: str = "text", limit: int = SHARD_BYTES) -> DataFrame:
    """One row for each row of ``df``: its id, n_bytes, shard (the bits of its prefix), depth (their number), shard_bytes, shard_rows, overflow."""
    slim = measured(df, id_column, text, F.col(id_column).alias("id"), row_hash().alias("tie"))
    directory = full_directory(slim, *first_directory(slim, limit), limit)
    way = ways(directory, F.col("key"), F.col("tie"))
    found = slim.select("id", "n_bytes", way.alias("way")).select("id", "n_bytes", "way.*").join(directory, ["root", "depth", "prefix"])
    return found.select(F.col("id").alias(id_column), "n_bytes", "shard", F.length("shard").alias("depth"), "shard_bytes", "shard_rows", (F.col("shard_bytes") > limit).alias("overflow"))


def write_shards(df: DataFrame, path: str, id_column: str = "doc_id", text: str = "text", limit: int = SHARD_BYTES) -> DataFrame:
    """Write ``df`` with one folder for each shard, and return the directory of what was written.

    Rows meet their shard by the same key, so ids need not be unique. The rows are written once more before, with their numbers, only if repeated rows exceed the limit together."""
    slim = measured(df, id_column, text)
    first, crowded, n_crowded = first_directory(slim, limit)
    rows, tie = df, F.lit(0).cast("long")
    if n_crowded:
        rows, tie = written(df.withColumn("__shard_tie", row_hash()), "tied"), F.col("__shard_tie")
        slim = measured(rows, id_column, text, tie.alias("tie"))
    directory = written(full_directory(slim, first, crowded, n_crowded, limit), "directory")
    way = ways(directory, hash_key(F.col(id_column), F.col(text)), tie)
    name = F.when(F.col("shard") == "", "all").otherwise(F.col("shard"))
    named = directory.select(F.struct("root", "depth", "prefix").alias("__shard_way"), name.alias("__shard"))
    rows.withColumn("__shard_way", way).join(named, "__shard_way").drop("__shard_way", "__shard_tie").repartition("__shard").write.partitionBy("__shard").parquet(path)
    return directory.select("shard", F.length("shard").alias("depth"), "shard_bytes", "shard_rows", (F.col("shard_bytes") > limit).alias("overflow"))
