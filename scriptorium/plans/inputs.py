"""How the driver's tables stand in for the engine's: each builder has a DataFrame and a SQL form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.text import ascii_fold
from scriptorium.session import table


def _swap(text: Column, a: str, b: str) -> Column:
    return F.replace(text, F.lit(a), F.lit(b))


#: Cells of the matrix: model, preprocessing, the corruption as a column and as SQL of ``ref``.
CELLS = (
    ("claude", "raw", lambda t: _swap(t, "th", "t"), "replace(ref, 'th', 't')"),
    ("claude", "opus_raw", lambda t: t, "ref"),
    ("claude", "preprocessed", lambda t: _swap(t, "e", "c"), "replace(ref, 'e', 'c')"),
    ("tesseract", "raw", lambda t: _swap(_swap(t, "th", "t"), "a", "o"), "replace(replace(ref, 'th', 't'), 'a', 'o')"),
    ("tesseract", "preprocessed", lambda t: F.concat(t, F.lit("x" * 40)), "ref || repeat('x', 40)"),
    ("gemini", "raw", lambda t: _swap(t, " ", ""), "replace(ref, ' ', '')"),
    ("gemini", "deskew_only", lambda t: _swap(t, "o", "0"), "replace(ref, 'o', '0')"),
)

#: What each cell's corruption does to a text, as edits of a category that can be counted in it: model, preprocessing, category, the characters that each stand for an edit (none: one edit for each page).
KNOWN_EDITS = (
    ("claude", "raw", "latin_punctuation", ("th",)),
    ("claude", "preprocessed", "latin_punctuation", ("e",)),
    ("tesseract", "raw", "latin_punctuation", ("th", "a")),
    ("tesseract", "preprocessed", "hallucination_burst", ()),
    ("gemini", "raw", "whitespace", (" ",)),
    ("gemini", "deskew_only", "latin_punctuation", ("o",)),
)

_CELL_SQL = " UNION ALL ".join(f"SELECT book_id, page_id, ref, '{m}' AS model, '{p}' AS preprocessing, {sql} AS text FROM t" for m, p, _, sql in CELLS)


def conversation_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("role").alias("book_id"), F.concat_ws("-", "conv_id", "turn").alias("page_id"), ascii_fold(F.col("text")).alias("ref"))


def benchmark_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.concat(F.lit("book"), F.col("item_id") % 5).alias("book_id"), F.col("item_id").cast("string").alias("page_id"), ascii_fold(F.col("text")).alias("ref"))


def known_units(truth: DataFrame) -> DataFrame:
    """(model, preprocessing, units): of every page and cell, the edits that its corruption makes, by category."""
    times = lambda what: F.floor((F.length("ref") - F.length(F.replace("ref", F.lit(what), F.lit("")))) / len(what)).cast("int")
    made = {(m, p): (category, sum((times(w) for w in what), F.lit(0)) if what else F.lit(1)) for m, p, category, what in KNOWN_EDITS}
    none = F.create_map().cast("map<string,int>")
    units = lambda m, p: F.when(made[m, p][1] > 0, F.create_map(F.lit(made[m, p][0]), made[m, p][1])).otherwise(none) if (m, p) in made else none
    cells = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.lit(p).alias("preprocessing"), units(m, p).alias("units")) for m, p, *_ in CELLS)))
    return truth.select(cells.alias("c")).select("c.*")


TRUTH_SQL = {
    "conversations": "SELECT role AS book_id, conv_id || '-' || turn AS page_id, regexp_replace(text, '[^ -~]', '?', 'g') AS ref FROM conversations WHERE regexp_matches(text, '\\S')",
    "benchmark": "SELECT 'book' || (item_id % 5) AS book_id, item_id::VARCHAR AS page_id, regexp_replace(text, '[^ -~]', '?', 'g') AS ref FROM benchmark WHERE regexp_matches(text, '\\S')",
}


def transcriptions(truth: DataFrame) -> DataFrame:
    """Every page in every cell."""
    cells = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.lit(p).alias("preprocessing"), f(F.col("ref")).alias("text")) for m, p, f, _ in CELLS)))
    return truth.select("book_id", "page_id", cells.alias("c")).select("book_id", "page_id", "c.*")


def scores_sql(source: str = "conversations") -> str:
    """CTEs t (truth), h (transcriptions) and s (with cer)."""
    return f"WITH t AS MATERIALIZED ({TRUTH_SQL[source]}), h AS MATERIALIZED ({_CELL_SQL}), s AS MATERIALIZED (SELECT book_id, page_id, model, preprocessing, CASE WHEN text = '' THEN 1.0 ELSE levenshtein(ref, text)::DOUBLE / length(ref) END AS cer FROM h)"


def known_sql(categories: tuple[str, ...]) -> str:
    """Counts of edits of every cell and category, and the cell's pages."""
    times = lambda what: f"((length(ref) - length(replace(ref, '{what}', ''))) // {len(what)})"
    made = {(m, p): (category, " + ".join(times(w) for w in what) or "1") for m, p, category, what in KNOWN_EDITS}
    of = lambda m, p: f"SELECT '{m}' AS model, '{p}' AS preprocessing, '{made.get((m, p), ('none',))[0]}' AS made, sum({made[m, p][1] if (m, p) in made else 0}) AS edits, count(*) AS n_pages FROM t"
    each = " UNION ALL ".join(of(m, p) for m, p, *_ in CELLS)
    names = ", ".join(f"'{c}'" for c in categories)
    return f"SELECT model, preprocessing, category, (CASE WHEN category = made THEN edits ELSE 0 END)::BIGINT AS count, n_pages FROM (WITH t AS ({TRUTH_SQL['conversations']}) {each}), (SELECT unnest([{names}]) AS category)"


def document_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as pages: sources as books, sizes from the texts."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), F.col("doc_id").cast("string").alias("page_id"), F.col("lang").alias("quality_bucket"), F.col("n_chars").alias("image_bytes"), F.octet_length("text").cast("long").alias("text_bytes"), F.lit(1700).alias("image_width"), (F.col("n_chars") % 400 + 2000).cast("int").alias("image_height"))


INVENTORY_SQL = "SELECT source AS book_id, doc_id::VARCHAR AS page_id, lang AS quality_bucket, n_chars AS image_bytes, strlen(text)::BIGINT AS text_bytes, 1700 AS image_width, (n_chars % 400 + 2000)::INT AS image_height FROM documents"


def event_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a manifest: types as models, values as latencies; 'error' rows failed, 'view' rows were skipped."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("page_id"), F.col("user_id").cast("string").alias("book_id"), kind.alias("model"), F.when(~kind.isin("error", "view"), F.col("value")).alias("latency_ms"), (kind == "view").alias("skipped"), F.when(kind == "error", "RuntimeError: failed").alias("error"), "ts", "props")


MANIFEST_SQL = "SELECT event_id::VARCHAR AS page_id, user_id::VARCHAR AS book_id, event_type AS model, CASE WHEN event_type NOT IN ('error', 'view') THEN value END AS latency_ms, event_type = 'view' AS skipped, CASE WHEN event_type = 'error' THEN 'RuntimeError: failed' END AS error, ts, props FROM events"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal."""
    return df.select(*(F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))
