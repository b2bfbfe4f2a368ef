"""Secret scans over an incremental blob ledger (operator 1), in DataFrame operations only.

Every version of a file is content-addressed by the SHA-256 of its text. The ledger is a Parquet
table with a row (blob, rule, version, spans) for each blob and rule version scanned so far, clean
ones included. ``scan`` scans only pairs that the ledger lacks, appends them, and joins the
findings back to every path that holds the blob. Offsets are code points, ends exclusive.

Positions come from splitting the text by the rule's pattern: the k-th match starts after the first
k + 1 pieces and the k matches before it.

Cases: a null text is an empty one. Identical texts are scanned once. Paths may repeat or be null.
A table without rows gives no findings and leaves the ledger as it was. Only the named columns are
read, so other columns cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm.support import written

#: Matches whose positions are found together; blobs with something to do up to which their table is broadcast.
BLOCK, MAX_BROADCAST = 256, 250_000


@dataclass(frozen=True)
class Rule:
    """``keep`` holds for a match that counts, given the match as a column."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    def keep(self, match: Column) -> Column:
        return F.length(F.regexp_extract(match, self.pattern, self.group) if self.group else match) >= self.least


#: The patterns of the three base rules. Runs of a class are maximal, so {n,} finds the same spans as + and a length check.
RULES = (
    Rule("assign", 1, r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}", 0, 16),
    Rule("hex", 1, r"[0-9a-f]{32,}", 0, 32),
)

SPAN = "array<struct<start:int,end:int>>"
LEDGER = T.StructType([T.StructField("blob", T.BinaryType()), T.StructField("rule", T.StringType()), T.StructField("version", T.IntegerType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))])


def spans(text: Column, rule: Rule) -> Column:
    """Of each match of ``rule`` that counts, its start and end."""
    parts = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("match"))
    size = lambda part: F.length(part["gap"]) + F.coalesce(F.length(part["match"]), F.lit(0))
    none = F.array().cast(SPAN)

    def walked(block: Column, begin: Column) -> Column:
        def step(state: Column, part: Column) -> Column:
            end = state["at"] + size(part)
            start = end - F.coalesce(F.length(part["match"]), F.lit(0))
            one = F.array(F.struct(start.alias("start"), end.alias("end")))
            counts = F.coalesce(rule.keep(part["match"]), F.lit(False))
            return F.struct(end.alias("at"), F.when(counts, F.concat(state["found"], one)).otherwise(state["found"]).alias("found"))

        return F.aggregate(block, F.struct(begin.alias("at"), none.alias("found")), step)["found"]

    def located(parts: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / BLOCK).cast("int")), lambda b: F.slice(parts, b * BLOCK + 1, F.lit(BLOCK)))
        sums = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda n, part: n + size(part)))
        begins = F.aggregate(sums, F.array(F.lit(0)), lambda done, n: F.concat(done, F.array(F.element_at(done, -1) + n)))
        return F.flatten(F.zip_with(blocks, F.slice(begins, F.lit(1), F.size(begins) - 1), walked))

    # A transform of one element computes the parts once.
    return F.when(text.rlike(rule.pattern), F.get(F.transform(F.array(parts), located), F.lit(0))).otherwise(none)


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def read_ledger(spark, path: str) -> DataFrame | None:
    """The ledger at ``path``, or None if there is none yet."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.schema(LEDGER).parquet(path)


def pending(blobs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``blobs`` with, in ``todo``, the names of the rules whose present version hasn't seen the blob; without blobs that all have."""
    names = F.array(*(F.lit(r.kind) for r in rules))
    now = F.array(*(F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version")) for r in rules))
    done = ledger.filter(F.array_contains(now, F.struct("rule", "version"))).groupBy("blob").agg(F.collect_set("rule").alias("done"))
    todo = F.array_except(names, F.coalesce("done", F.array().cast("array<string>")))
    return blobs.join(done, "blob", "left").withColumn("todo", todo).drop("done").filter(F.size("todo") > 0)


def unseen(known: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, text, todo): a row for each distinct blob of ``known`` (blob, text) with something to scan."""
    if ledger is None:
        return known.groupBy("blob").agg(F.first("text").alias("text")).withColumn("todo", F.array(*(F.lit(r.kind) for r in rules)))
    todo = written(pending(known.select("blob").distinct(), ledger, rules), "todo")
    few = todo.count() <= MAX_BROADCAST
    return known.join(F.broadcast(todo) if few else todo, "blob").groupBy("blob").agg(F.first("text").alias("text"), F.first("todo").alias("todo"))


def scan(versions: DataFrame, ledger_path: str, path: str = "path", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger lacks, append it, and return a row (path, blob, findings) for each row of ``versions``.

    findings: array of (kind, start, end) by start, then by the order of ``rules``."""
    spark = versions.sparkSession
    ledger = read_ledger(spark, ledger_path)
    known = versions.select(F.col(path).alias("path"), blob_of(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = F.filter(F.array(*(F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"), F.when(F.array_contains("todo", r.kind), spans(F.col("text"), r)).alias("spans")) for r in rules)), lambda x: x["spans"].isNotNull())
    unseen(known.select("blob", "text"), ledger, rules).select("blob", F.inline(found)).write.mode("append").parquet(ledger_path)
    return joined(known.select("path", "blob"), read_ledger(spark, ledger_path), rules)


def joined(known: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger's findings of each path's blob, under the present rule versions."""
    rank = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))))
    now = F.array(*(F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version")) for r in rules))
    hits = ledger.filter((F.size("spans") > 0) & F.array_contains(now, F.struct("rule", "version")))
    # A writer that ran twice may have appended a pair twice; max() keeps one.
    one = hits.groupBy("blob", "rule").agg(F.max("spans").alias("spans"))
    rows = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), rank[F.col("rule")].alias("rank"), F.col("rule").alias("kind"), s["end"].alias("end")))
    each = one.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list(rows))).alias("all"))
    findings = F.transform(F.coalesce("all", F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return known.join(each, "blob", "left").select("path", "blob", findings.alias("findings"))


#: A helping column; it begins like no column of a table should.
HIT = "__blob_with_secret"


def without_findings(df: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``df`` whose text has no finding in ``found`` (what ``scan`` gave). Null and empty texts, which may be very many, meet nothing and stay where they are."""
    if HIT in df.columns:
        raise ValueError(f"a column is called {HIT}")
    hit = found.filter(F.size("findings") > 0).select(F.col("blob").alias(HIT)).distinct()
    some = F.coalesce(F.col(text), F.lit("")) != ""
    return df.filter(some).join(hit, blob_of(F.col(text)) == F.col(HIT), "left_anti").unionByName(df.filter(~some))


def digest(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The findings of each path as counts, a string of spans and its SHA-256."""
    as_text = F.array_join(F.transform("findings", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(F.col("path").alias(id_column), *(count(r.kind) for r in RULES), F.sha2(as_text.cast("binary"), 256).alias("base_sha256"), as_text.alias("spans"))
