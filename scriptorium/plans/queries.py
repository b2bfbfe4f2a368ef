"""Registered queries of the engine's own operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import judge, metrics, order, stats, text
from scriptorium.operators import calibration, corpus, errors, logs, matrix, pairing, sampling
from scriptorium.plans import inputs
from scriptorium.plans.inputs import INVENTORY_SQL, MANIFEST_SQL, rounded, scores_sql
from scriptorium.session import table
from scriptorium.storage import saved

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def cer_scores(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """The matrix over ``conversations`` with CER, and ``more`` columns of ``ref`` and ``text``."""
    truth = inputs.conversation_truth(spark, sf_dir)
    paired = pairing.with_truth(inputs.transcriptions(truth), truth)
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return paired.repartition(n, "book_id", "page_id", "model", "preprocessing").select("book_id", "page_id", "model", "preprocessing", metrics.cer(F.col("ref"), F.col("text")).alias("cer"), *more)


# ---- metrics and the matrix

_WORDS = "list_filter(string_split_regex({0}, '\\s+'), lambda x: x <> '')"
_WER = f"""{scores_sql('benchmark')},
w AS (SELECT *, {_WORDS.format('ref')} AS a, {_WORDS.format('text')} AS b FROM h),
v AS (SELECT *, list_sort(list_distinct(list_concat(a, b))) AS names FROM w),
e AS (SELECT book_id, page_id, model, preprocessing, levenshtein(array_to_string(list_transform(a, lambda x: chr(list_position(names, x)::INT)), ''), array_to_string(list_transform(b, lambda x: chr(list_position(names, x)::INT)), ''))::DOUBLE / len(a) AS wer FROM v)"""


@query(f"""{_WER}
SELECT model, preprocessing, count(*) AS n, round(avg(cer), 6) AS mean_cer, round(list_sort(list(cer))[count(*) // 2 + 1], 6) AS median_cer,
  round(list_sort(list(cer))[least(floor(count(*) * 0.9)::BIGINT, count(*) - 1) + 1], 6) AS p90_cer, round(avg(wer), 6) AS mean_wer, round(list_sort(list(wer))[count(*) // 2 + 1], 6) AS median_wer
FROM s JOIN e USING (book_id, page_id, model, preprocessing) GROUP BY ALL""")
def cell_summary(spark, sf_dir):
    truth = inputs.benchmark_truth(spark, sf_dir)
    return matrix.summarize(matrix.score(inputs.transcriptions(truth), truth))


@query(f"{_WER} SELECT model, preprocessing, book_id, count(*) AS n, round(avg(wer), 6) AS mean_wer, round(max(wer), 6) AS max_wer FROM e GROUP BY ALL")
def wer_by_cell(spark, sf_dir):
    truth = inputs.benchmark_truth(spark, sf_dir)
    scores = matrix.score(inputs.transcriptions(truth), truth)
    return scores.groupBy("model", "preprocessing", "book_id").agg(F.count("*").alias("n"), F.avg("wer").alias("mean_wer"), F.max("wer").alias("max_wer"))


@query(f"{scores_sql()} SELECT model, preprocessing, book_id, page_id, round(cer, 6) AS cer FROM s")
def page_scores(spark, sf_dir):
    return cer_scores(spark, sf_dir)


@query(f"""{scores_sql()}, m AS (SELECT model, preprocessing, avg(cer) AS mean_cer, median(cer) AS median_cer, count(*) AS n FROM s GROUP BY ALL)
SELECT model, preprocessing, round(mean_cer, 6) AS mean_cer, round(median_cer, 6) AS median_cer, n, row_number() OVER (ORDER BY mean_cer, model, preprocessing)::INT AS place FROM m""")
def cell_mean_median(spark, sf_dir):
    return matrix.mean_median(cer_scores(spark, sf_dir))


@query(f"""{scores_sql()}, r AS (SELECT *, row_number() OVER (PARTITION BY model, preprocessing ORDER BY cer) AS r, count(*) OVER (PARTITION BY model, preprocessing) AS n FROM s)
SELECT model, preprocessing, round(max(cer) FILTER (r = n // 2 + 1), 6) AS upper_median, round(max(cer) FILTER (r = least(floor(n * 0.9)::BIGINT, n - 1) + 1), 6) AS p90 FROM r GROUP BY ALL""")
def ranked_quantiles(spark, sf_dir):
    scores = cer_scores(spark, sf_dir)
    keys = ["model", "preprocessing"]
    counts = scores.groupBy(*keys, "cer").agg(F.count("*").alias("times"))
    return order.placed(counts, keys, "cer", "times", {"upper_median": stats.upper_middle, "p90": stats.nine_tenths})


_VARIANTS = ", ".join(f"({i}, '{v}')" for i, v in enumerate(matrix.VARIANT_ORDER))


@query(f"""{scores_sql()}, v(variant_order, preprocessing) AS (VALUES {_VARIANTS}),
m AS (SELECT model, preprocessing, avg(cer) AS mean_cer, median(cer) AS median_cer, count(*) AS n FROM s GROUP BY ALL)
SELECT x.model, v.preprocessing, variant_order, round(mean_cer, 6) AS mean_cer, round(median_cer, 6) AS median_cer, coalesce(n, 0) AS n, round(CASE WHEN mean_cer IS NOT NULL THEN least(mean_cer, 1.0) END, 6) AS plotted, mean_cer > 1 AS clipped
FROM (SELECT DISTINCT m.model FROM m JOIN v USING (preprocessing)) x CROSS JOIN v LEFT JOIN m ON m.model = x.model AND m.preprocessing = v.preprocessing""")
def ablation_reindexed(spark, sf_dir):
    return matrix.ablation(cer_scores(spark, sf_dir))


_COSTS = ", ".join(f"('{m}', '{p}', {c})" for m, p, c in matrix.COST_PER_PAGE)
_COST_CTE = f"c(model, preprocessing, cost) AS (VALUES {_COSTS})"


@query(f"""{scores_sql()}, {_COST_CTE}, m AS (SELECT model, preprocessing, avg(cer) AS mean_cer FROM s GROUP BY ALL),
j AS (SELECT m.*, coalesce(cost, 0.0)::DOUBLE AS cost_per_page, cost IS NOT NULL AS cost_known FROM m LEFT JOIN c USING (model, preprocessing))
SELECT model, preprocessing, round(mean_cer, 6) AS mean_cer, cost_per_page, cost_known, CASE WHEN cost_per_page > 0 THEN cost_per_page ELSE 0.00001 END::DOUBLE AS shown_cost,
  row_number() OVER (ORDER BY cost_per_page, mean_cer, model, preprocessing)::INT AS place FROM j""")
def cost_quality(spark, sf_dir):
    return matrix.cost_quality(cer_scores(spark, sf_dir), matrix.cost_table(spark))


@query(f"""{scores_sql()}, {_COST_CTE}, m AS (SELECT model, preprocessing, avg(cer) AS mean_cer FROM s GROUP BY ALL),
b AS (SELECT mean_cer AS base FROM m WHERE model = 'tesseract' AND preprocessing = 'raw')
SELECT model, preprocessing, round(CASE WHEN base > mean_cer THEN coalesce(cost, 0) / (base - mean_cer) END, 6) AS cost_per_point FROM m CROSS JOIN b LEFT JOIN c USING (model, preprocessing)""")
def cost_per_point(spark, sf_dir):
    scores = cer_scores(spark, sf_dir, F.length("ref").alias("length"))
    means = scores.groupBy("model", "preprocessing").agg(stats.mean_ratio(F.col("cer"), F.col("length")).alias("mean_cer"))
    cells = pairing.with_cost(means, matrix.cost_table(spark))
    return matrix.cost_per_point(cells, ("tesseract", "raw")).select("model", "preprocessing", "cost_per_point")


@query(f"""{scores_sql()} SELECT model, preprocessing, round(avg(cer), 6) AS mean_cer, round(avg(least(cer, 1.0)), 6) AS capped_mean_cer, count(*) FILTER (cer > 1) AS n_outliers, round(avg(cer) - avg(least(cer, 1.0)), 6) AS delta FROM s GROUP BY ALL""")
def capped_cer(spark, sf_dir):
    return matrix.capped(cer_scores(spark, sf_dir))


@query(f"""{scores_sql()} SELECT model, round(avg(cer) FILTER (book_id = 'user'), 6) AS "user", round(avg(cer) FILTER (book_id = 'assistant'), 6) AS assistant, round(avg(cer) FILTER (book_id = 'system'), 6) AS system FROM s GROUP BY model""")
def bucket_pivot(spark, sf_dir):
    scores = cer_scores(spark, sf_dir)
    buckets = inputs.conversation_truth(spark, sf_dir).select("book_id", "page_id", F.col("book_id").alias("quality_bucket"))
    return matrix.bucket_pivot(scores, buckets, ["user", "assistant", "system"])


@query(f"""{scores_sql()}, q AS (SELECT book_id, model, count(*) AS n, quantile_cont(cer, 0.25) AS q1, quantile_cont(cer, 0.5) AS median, quantile_cont(cer, 0.75) AS q3 FROM s GROUP BY ALL)
SELECT book_id, model, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
  round(min(cer) FILTER (cer BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_low, round(max(cer) FILTER (cer BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_high,
  count(*) FILTER (NOT cer BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_fliers
FROM s JOIN q USING (book_id, model) GROUP BY ALL""")
def bucket_five_number(spark, sf_dir):
    return order.five_numbers(cer_scores(spark, sf_dir), ["book_id", "model"], "cer")


@query(f"""{scores_sql()}, m AS (SELECT model, book_id, avg(cer) AS x FROM s GROUP BY ALL), w AS (SELECT role AS book_id, count(*) AS w FROM conversations GROUP BY ALL)
SELECT model, round(sum(w * x) / sum(w), 6) AS weighted_cer FROM m JOIN w USING (book_id) GROUP BY model""")
def weighted_cer(spark, sf_dir):
    prevalence = table(spark, sf_dir, "conversations").groupBy(F.col("role").alias("book_id")).agg(F.count("*").alias("weight"))
    return matrix.weighted_mean(cer_scores(spark, sf_dir), prevalence, "book_id")


@query(f"""WITH m AS ({MANIFEST_SQL}), a AS (SELECT model, avg(latency_ms) / 1000 AS latency_s, 0.01 AS c FROM m WHERE latency_ms IS NOT NULL GROUP BY model)
SELECT model, round(c * 17000, 6)::DOUBLE AS total_cost, round(latency_s * 17000 / 3600, 6) AS hours_sequential, round(latency_s * 17000 / 3600 / 10, 6) AS hours_parallel FROM a""")
def extrapolation(spark, sf_dir):
    cells = inputs.event_manifest(spark, sf_dir).filter("latency_ms is not null").groupBy("model").agg((F.avg("latency_ms") / 1000).alias("latency_s"), F.lit(0.01).alias("cost_per_page"))
    return matrix.extrapolate(cells, 17000, 10).select("model", "total_cost", "hours_sequential", "hours_parallel")


@query()
def document_cer(spark, sf_dir):
    """CER of whole documents, whatever their length; tested against a table-based distance."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("ref"), F.replace(F.col("text"), F.lit("th"), F.lit("t")).alias("hyp")).filter(F.col("ref").rlike(r"\S"))
    return docs.repartition(max(spark.sparkContext.defaultParallelism * 2, int(spark.conf.get("spark.sql.shuffle.partitions"))), "doc_id").select("doc_id", metrics.cer(F.col("ref"), F.col("hyp")).alias("cer"))


# ---- joins and sets

_SIDES = "i AS (SELECT DISTINCT source AS book_id, doc_id::VARCHAR AS page_id FROM documents), t AS (SELECT DISTINCT source AS book_id, doc_id::VARCHAR AS page_id FROM documents JOIN labels USING (doc_id) UNION SELECT 'orphan', item_id::VARCHAR FROM benchmark)"


def _sides(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    page = lambda d: d.select(F.col("source").alias("book_id"), F.col("doc_id").cast("string").alias("page_id"))
    orphans = table(spark, sf_dir, "benchmark").select(F.lit("orphan").alias("book_id"), F.col("item_id").cast("string").alias("page_id"))
    return page(docs).distinct(), page(docs.join(labels, "doc_id")).union(orphans).distinct()


@query(f"WITH {_SIDES} SELECT *, NULL AS reason FROM (FROM i INTERSECT FROM t) UNION ALL SELECT *, 'missing_text' FROM (FROM i EXCEPT FROM t) UNION ALL SELECT *, 'missing_image' FROM (FROM t EXCEPT FROM i)")
def pairing_mismatches(spark, sf_dir):
    return pairing.pair(*_sides(spark, sf_dir))


@query(f"WITH {_SIDES} SELECT (SELECT count(*) FROM i JOIN t USING (book_id, page_id)) AS n_paired, (SELECT count(*) FROM (FROM i EXCEPT FROM t)) AS n_missing_text, (SELECT count(*) FROM (FROM t EXCEPT FROM i)) AS n_missing_image")
def pairing_counts(spark, sf_dir):
    return pairing.pairing_counts(*_sides(spark, sf_dir))


@query("WITH a AS (SELECT DISTINCT lang, source FROM documents JOIN labels USING (doc_id) WHERE quality = 1), b AS (SELECT DISTINCT lang, source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1) SELECT *, 'both' AS side FROM (FROM a INTERSECT FROM b) UNION ALL SELECT *, 'left' FROM (FROM a EXCEPT FROM b) UNION ALL SELECT *, 'right' FROM (FROM b EXCEPT FROM a)")
def set_sides(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return pairing.set_comparison(joined.filter("quality = 1").select("lang", "source"), joined.filter("toxic = 1").select("lang", "source"))


@query("SELECT doc_id, quality, toxic, lang FROM labels JOIN documents USING (doc_id)")
def one_to_one_join(spark, sf_dir):
    return pairing.one_to_one(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "lang"), ("doc_id",))


@query("SELECT doc_id, source, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def incremental_pending(spark, sf_dir):
    return pairing.pending(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), table(spark, sf_dir, "labels"), ("doc_id",))


@query("SELECT doc_id, source, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def subset_files(spark, sf_dir):
    return pairing.subset(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), table(spark, sf_dir, "labels").filter("quality = 0"), ("doc_id",))


@query("WITH f AS (SELECT doc_id AS id, lang || '/' || source || '.png' AS output_path, lpad(doc_id::VARCHAR, 12, '0') AS input_path FROM documents) SELECT output_path, input_path, CASE WHEN input_path = min(input_path) OVER (PARTITION BY output_path) THEN 'kept' ELSE 'collision' END AS status FROM f")
def output_collisions(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.concat("lang", F.lit("/"), "source", F.lit(".png")).alias("output_path"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("input_path"))
    return pairing.output_collisions(files)


@query("""WITH n AS (SELECT DISTINCT repeat('.', (doc_id % 3)::INT) || CASE WHEN doc_id % 7 = 0 THEN '' ELSE source END AS name FROM documents), t AS (SELECT name, regexp_replace(name, '^\\.+', '') AS target FROM n)
SELECT name, target, CASE WHEN target = '' THEN 'empty' WHEN count(*) OVER (PARTITION BY target) > 1 THEN 'collision' WHEN target <> name THEN 'rename' ELSE 'unchanged' END AS status FROM t""")
def dot_normalise(spark, sf_dir):
    names = table(spark, sf_dir, "documents").select(F.concat(F.expr("repeat('.', cast(doc_id % 3 as int))"), F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("source"))).alias("name")).distinct()
    return pairing.target_names(names)


@query("SELECT DISTINCT split_part(regexp_replace(url, '^https?://', ''), '/', 1) AS folder FROM pages WHERE regexp_replace(url, '^https?://', '') LIKE '%/%'")
def top_folders(spark, sf_dir):
    from scriptorium.sources.corpus import top_folders as folders

    return folders(table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^https?://", "").alias("path")))


# ---- sampling

@query("WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || doc_id), doc_id) AS r FROM documents) SELECT doc_id, lang FROM r WHERE r <= 6")
def stratified_sample(spark, sf_dir):
    return sampling.stratified(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", ["doc_id"], 6)


@query("SELECT doc_id, text = nfc_normalize(text) AS is_nfc, length(text)::INT AS n_chars, left(text, 30) AS preview FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 20")
def spot_check(spark, sf_dir):
    chosen = sampling.spot_check(table(spark, sf_dir, "documents"), ["doc_id"], 20)
    return chosen.select("doc_id", text.is_nfc(F.col("text")).alias("is_nfc"), F.length("text").alias("n_chars"), text.preview(F.col("text")).alias("preview"))


@query("""WITH e AS (SELECT quantile_cont(n_chars, [0.2, 0.4, 0.6, 0.8]) AS e FROM documents), p AS (SELECT doc_id, len(list_filter(e, lambda x: x < n_chars)) + 1 AS stratum FROM documents, e),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('42|' || doc_id), doc_id) AS r FROM p) SELECT doc_id, stratum::INT AS stratum FROM r WHERE r <= 10""")
def size_quintiles(spark, sf_dir):
    return sampling.quantile_strata(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", ["doc_id"], 10).select("doc_id", "stratum")


@query("WITH b AS (SELECT conv_id, role FROM conversations), r AS (SELECT conv_id, role, CASE role WHEN 'system' THEN 1 WHEN 'assistant' THEN 2 WHEN 'user' THEN 3 ELSE 4 END AS p FROM b) SELECT conv_id, arg_min(role, p) AS role FROM r GROUP BY conv_id")
def priority_bucket(spark, sf_dir):
    return sampling.priority_bucket(table(spark, sf_dir, "conversations").select("conv_id", "role"), ["conv_id"], "role", ("system", "assistant", "user"))


@query("SELECT DISTINCT source FROM documents ORDER BY source LIMIT 5")
def first_n_sources(spark, sf_dir):
    return sampling.first_n(table(spark, sf_dir, "documents"), "source", 5)


# ---- corpus statistics

@query(f"WITH i AS ({INVENTORY_SQL}) SELECT count(DISTINCT book_id) AS n_books, count(*) AS n_pages, sum(image_bytes)::BIGINT AS image_bytes, sum(text_bytes)::BIGINT AS text_bytes FROM i")
def corpus_totals(spark, sf_dir):
    return corpus.totals(inputs.document_inventory(spark, sf_dir))


@query(f"WITH i AS ({INVENTORY_SQL}) SELECT count(*) AS n_pages, count(DISTINCT book_id) AS n_books, trunc(avg(image_width))::BIGINT AS mean_width, trunc(median(image_height))::BIGINT AS median_height, count(DISTINCT image_width) = 1 AS uniform_width, CASE WHEN count(DISTINCT image_width) = 1 THEN min(image_width) END AS width, round(avg(text_bytes), 6) AS mean_text_length_chars, round(avg(image_width) / 6.0, 6) AS dpi_estimate FROM i")
def corpus_stats(spark, sf_dir):
    return corpus.stats_row(inputs.document_inventory(spark, sf_dir))


_DESCRIBE = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c})::DOUBLE AS min, quantile_cont({c}::DOUBLE, 0.25) AS p25, quantile_cont({c}::DOUBLE, 0.5) AS p50, quantile_cont({c}::DOUBLE, 0.75) AS p75, max({c})::DOUBLE AS max FROM i" for c in ("image_bytes", "text_bytes", "image_height"))


@query(f"WITH i AS ({INVENTORY_SQL}) {_DESCRIBE}")
def describe_numeric(spark, sf_dir):
    return stats.describe(inputs.document_inventory(spark, sf_dir), ["image_bytes", "text_bytes", "image_height"])


@query(f"""WITH i AS ({INVENTORY_SQL}), m AS (SELECT min(text_bytes)::DOUBLE AS lo, max(text_bytes)::DOUBLE AS hi FROM i), b AS (SELECT unnest(range(0, 20))::INT AS bin),
c AS (SELECT least(floor((text_bytes - lo) / (hi - lo) * 20), 19)::INT AS bin, count(*) AS n FROM i, m GROUP BY ALL)
SELECT bin, round(lo + bin * ((hi - lo) / 20), 6) AS low, round(lo + (bin + 1) * ((hi - lo) / 20), 6) AS high, coalesce(n, 0) AS n FROM b CROSS JOIN m LEFT JOIN c USING (bin)""")
def text_histogram(spark, sf_dir):
    return stats.histogram(inputs.document_inventory(spark, sf_dir), "text_bytes")


@query("SELECT source AS book_id, count(*) AS n_pages FROM documents GROUP BY ROLLUP (source)")
def pages_per_book(spark, sf_dir):
    return corpus.pages_per_book(inputs.document_inventory(spark, sf_dir))


@query("WITH c AS (SELECT l_linenumber AS fluency_rating, count(*) AS n FROM lineitem GROUP BY ALL) SELECT fluency_rating, n, round(100.0 * n / sum(n) OVER (), 6) AS percent, round(sum(fluency_rating * n) OVER () / sum(n) OVER (), 6) AS mean_rating FROM c")
def rating_distribution(spark, sf_dir):
    return corpus.rating_distribution(table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("fluency_rating")))


@query(f"WITH m AS ({MANIFEST_SQL}) SELECT model, count(*) AS found, count(*) FILTER (NOT skipped AND error IS NULL) AS processed, count(*) FILTER (skipped) AS skipped, count(*) FILTER (error IS NOT NULL) AS failed FROM m GROUP BY model")
def run_counters(spark, sf_dir):
    return corpus.run_counters(inputs.event_manifest(spark, sf_dir), ("model",))


@query(f"WITH m AS ({MANIFEST_SQL}) SELECT model, round(avg(latency_ms), 1) AS mean_latency, round(median(latency_ms), 6) AS median_latency, count(latency_ms) AS n FROM m GROUP BY model")
def latency_by_cell(spark, sf_dir):
    return corpus.latency(inputs.event_manifest(spark, sf_dir))


@query("SELECT event_id, event_type, value FROM events ORDER BY value DESC, event_id LIMIT 10")
def slowest_events(spark, sf_dir):
    return corpus.slowest(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), "value", 10, ("event_id",))


# ---- correlations

_PEARSON = "CASE WHEN isfinite(corr({0}, {1})) THEN round(corr({0}, {1}), 6) END"


def _rated(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("preprocessing"), F.col("l_quantity").alias("fluency_rating"), F.col("l_discount").alias("cer"), F.lit(1.0).alias("flat"))


@query(f"SELECT l_returnflag AS model, {_PEARSON.format('l_quantity', 'l_extendedprice')} AS r, CAST(NULL AS DOUBLE) AS flat FROM lineitem GROUP BY ALL")
def pearson_overall(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy(F.col("l_returnflag").alias("model")).agg(stats.pearson(F.col("l_quantity"), F.col("l_extendedprice")).alias("r"), stats.pearson(F.col("l_quantity"), F.lit(1.0)).alias("flat"))


_RANK = "(rank() OVER (PARTITION BY {k} ORDER BY {c}) + (count(*) OVER (PARTITION BY {k}, {c}) - 1) / 2.0)::DOUBLE"


@query(f"""WITH r AS (SELECT l_returnflag AS model, l_linestatus AS preprocessing, {_RANK.format(k='l_returnflag, l_linestatus', c='l_quantity')} AS a, {_RANK.format(k='l_returnflag, l_linestatus', c='l_discount')} AS b FROM lineitem)
SELECT model, preprocessing, count(*) AS n, {_PEARSON.format('a', 'b')} AS rho FROM r GROUP BY ALL HAVING count(*) >= 5""")
def spearman_by_cell(spark, sf_dir):
    return stats.spearman(_rated(spark, sf_dir), "fluency_rating", "cer", ["model", "preprocessing"], 5)


@query(f"""WITH r AS (SELECT l_returnflag AS model, l_quantity AS x, l_discount AS y, {_RANK.format(k='l_returnflag', c='l_quantity')} AS a, {_RANK.format(k='l_returnflag', c='l_discount')} AS b, {_RANK.format(k='1', c='l_quantity')} AS c, {_RANK.format(k='1', c='l_discount')} AS d FROM lineitem)
SELECT 'spearman_' || model AS metric, {_PEARSON.format('a', 'b')} AS value FROM r GROUP BY model HAVING count(*) >= 5 UNION ALL SELECT 'spearman_rating', {_PEARSON.format('c', 'd')} FROM r UNION ALL SELECT 'pearson_rating', {_PEARSON.format('x', 'y')} FROM r""")
def correlation_summary(spark, sf_dir):
    return calibration.correlations(_rated(spark, sf_dir), "fluency_rating", "cer", "rating", ("model",))


@query(f"""WITH d AS (SELECT l_quantity - l_tax * 1000 + 0.5 AS d FROM lineitem), z AS (SELECT d, abs(d) AS size FROM d WHERE d <> 0), r AS (SELECT d, {_RANK.format(k='1', c='size')} AS r FROM z)
SELECT count(*) AS n, coalesce(sum(r) FILTER (d > 0), 0) AS w_plus, coalesce(sum(r) FILTER (d < 0), 0) AS w_minus FROM r""")
def signed_ranks(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") - F.col("l_tax") * 1000 + 0.5).alias("x"), F.lit(0.0).alias("y"))
    return stats.wilcoxon(rows, "x", "y")


# ---- error categories

_COUNTS = inputs.known_sql(metrics.CATEGORIES)


def _counts(spark, sf_dir):
    """Edits of the corruptions of ``conversations``, which are known by their making."""
    return errors.by_cell(inputs.known_units(inputs.conversation_truth(spark, sf_dir).filter(F.col("ref").rlike(r"\S"))))


@query(f"WITH c AS ({_COUNTS}) SELECT model, preprocessing, sum(count)::BIGINT AS total, " + ", ".join(f"round(CASE WHEN sum(count) = 0 THEN 0 ELSE sum(count) FILTER (category = '{c}') / sum(count) END, 6)::DOUBLE AS {c}" for c in metrics.CATEGORIES) + " FROM c GROUP BY ALL")
def category_shares(spark, sf_dir):
    return matrix.category_shares(_counts(spark, sf_dir), metrics.CATEGORIES)


@query(f"""WITH c AS ({_COUNTS}), s AS (SELECT model, preprocessing, category, CASE WHEN sum(count) OVER w = 0 THEN 0 ELSE count / sum(count) OVER w END AS share, list_position([{', '.join(repr(c) for c in metrics.CATEGORIES)}], category) AS o FROM c WINDOW w AS (PARTITION BY model, preprocessing)),
r AS (SELECT *, row_number() OVER (PARTITION BY model, preprocessing ORDER BY share DESC, o)::INT AS place FROM s) SELECT model, preprocessing, place, category, round(share, 6)::DOUBLE AS share FROM r WHERE place <= 3""")
def top3_categories(spark, sf_dir):
    return matrix.top_categories(_counts(spark, sf_dir), metrics.CATEGORIES)


@query(_COUNTS)
def category_dense(spark, sf_dir):
    return _counts(spark, sf_dir)


@query(f"WITH c AS ({_COUNTS}) SELECT model, preprocessing, sum(count)::BIGINT AS edits FROM c GROUP BY ALL")
def total_edits(spark, sf_dir):
    return errors.totals(_counts(spark, sf_dir))


@query("""WITH w AS (SELECT DISTINCT unnest(string_split(regexp_replace(text, '[^ -~]', ' ', 'g'), 'e')) AS t FROM benchmark)
SELECT t, CASE WHEN t = '' THEN 'other' WHEN regexp_full_match(t, ' +') THEN 'whitespace' WHEN regexp_matches(t, '[!-~]') THEN 'latin_punctuation' ELSE 'other' END AS class FROM w""")
def edit_class_ascii(spark, sf_dir):
    parts = table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.regexp_replace("text", "[^ -~]", " "), "e", -1)).alias("t")).distinct()
    return parts.select("t", text.edit_class(F.col("t")).alias("class"))


@query()
def error_categories(spark, sf_dir):
    """Edits of the matrix over ``benchmark`` by category; tested against a plain walk over opcodes."""
    truth = inputs.benchmark_truth(spark, sf_dir)
    return errors.by_cell(errors.page_units(inputs.transcriptions(truth), truth))


@query()
def page_agreement(spark, sf_dir):
    """Mean similarity of a page's cells; tested against difflib."""
    made = inputs.transcriptions(inputs.benchmark_truth(spark, sf_dir)).withColumn("cell", F.concat_ws("_", "model", "preprocessing"))
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return calibration.page_agreement(made.repartition(n, "book_id", "page_id"))


@query()
def agreement_calibration(spark, sf_dir):
    truth = inputs.benchmark_truth(spark, sf_dir)
    made = inputs.transcriptions(truth)
    scores = saved(matrix.score(made, truth), "scores")
    ratings = scores.select("book_id", "page_id", "model", "preprocessing", F.greatest(F.lit(1), 5 - F.floor(F.col("cer") * 10)).cast("int").alias("fluency_rating"))
    agreements = calibration.page_agreement(made.withColumn("cell", F.concat_ws("_", "model", "preprocessing")))
    return calibration.summary(scores, ratings, agreements)


# ---- text functions

@query("WITH c AS (SELECT DISTINCT replace(url[9:], '/', '_') AS cell FROM pages UNION SELECT DISTINCT lang FROM documents) SELECT cell, split_part(cell, '_', 1) AS model, CASE WHEN strpos(cell, '_') = 0 THEN 'unknown' ELSE substr(cell, strpos(cell, '_') + 1) END AS preprocessing FROM c")
def cell_name_split(spark, sf_dir):
    cells = table(spark, sf_dir, "pages").select(F.replace(F.expr("substring(url, 9)"), F.lit("/"), F.lit("_")).alias("cell")).union(table(spark, sf_dir, "documents").select("lang")).distinct()
    return cells.select("cell", text.model_of_cell(F.col("cell")).alias("model"), text.preprocessing_of_cell(F.col("cell")).alias("preprocessing"))


@query("""WITH p AS (SELECT conv_id, turn, trim(u, ' ' || chr(10)) AS s, u FROM (SELECT conv_id, turn, unnest(string_split(text, '.')) AS u FROM conversations))
SELECT conv_id, turn, u, length(s) BETWEEN 1 AND 29 AND NOT regexp_matches(u, '[\\x{C0}-\\x{FF}]') AS refusal, CASE WHEN s = '' OR (length(s) BETWEEN 1 AND 29 AND NOT regexp_matches(u, '[\\x{C0}-\\x{FF}]')) THEN '' ELSE u END AS kept FROM p""")
def refusal_filter(spark, sf_dir):
    parts = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.split("text", r"\.", -1)).alias("u"))
    return parts.select("conv_id", "turn", "u", text.is_refusal(F.col("u"), (0xC0, 0xFF)).alias("refusal"), text.model_output(F.col("u"), (0xC0, 0xFF)).alias("kept"))


@query("SELECT lang, regexp_matches(text, '[\\x{C0}-\\x{FF}]') AS accented, count(*) AS n FROM documents GROUP BY ALL")
def script_mix(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang", text.has_script(F.col("text"), (0xC0, 0xFF)).alias("accented")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, strlen(nfc_normalize(text))::INT AS nfc_bytes, text = nfc_normalize(text) AS is_nfc FROM documents")
def nfc_pairs(spark, sf_dir):
    made = text.nfc(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length(made).alias("nfc_bytes"), (F.col("text") == made).alias("is_nfc"))


@query("""SELECT doc_id, CASE WHEN b < 1024 THEN b || '.0 B' WHEN b < 1048576 THEN b // 1024 || '.0 KB' WHEN b < 1073741824 THEN b // 1048576 || '.0 MB' WHEN b < 1099511627776 THEN b // 1073741824 || '.0 GB' ELSE b // 1099511627776 || '.0 TB' END AS size FROM (SELECT doc_id, n_chars * n_chars * n_chars AS b FROM documents)""")
def format_bytes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.format_bytes(F.col("n_chars") * F.col("n_chars") * F.col("n_chars")).alias("size"))


@query("""WITH p AS (SELECT page_id, regexp_replace(url, '^https?://', '/') AS x FROM pages)
SELECT page_id, CASE WHEN starts_with(x, '/thther.example.org/') THEN substr(x, length('/thther.example.org/') + 1) ELSE x END AS relative FROM p""")
def relative_paths(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.relative_to(F.regexp_replace("url", "^https?://", "/"), "/thther.example.org").alias("relative"))


@query("""WITH e AS (SELECT event_id, CASE event_type WHEN 'click' THEN '.JPG' WHEN 'view' THEN '.jpeg' ELSE '.png' END AS x FROM events) SELECT event_id, CASE lower(x) WHEN '.png' THEN 'image/png' ELSE 'image/jpeg' END AS media_type, 'book/page' || '.txt' AS text_path FROM e""")
def media_types(spark, sf_dir):
    name = F.concat(F.lit("book/page"), F.when(F.col("event_type") == "click", ".JPG").when(F.col("event_type") == "view", ".jpeg").otherwise(".png"))
    return table(spark, sf_dir, "events").select("event_id", text.media_type(name).alias("media_type"), text.with_suffix(name, ".txt").alias("text_path"))


@query("SELECT conv_id, coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'user'), '') AS said, to_base64(encode(string_agg(role, ',' ORDER BY turn))) AS roles FROM conversations GROUP BY conv_id")
def joined_blocks(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("type"), "text"))).alias("blocks"))
    roles = F.array_join(F.transform("blocks", lambda b: b["type"]), ",")
    return turns.select("conv_id", text.joined_blocks(F.col("blocks"), "user").alias("said"), text.base64_line(roles.cast("binary")).alias("roles"))


@query("SELECT conv_id, turn, 'Rate {' || role || '}: ' || text || '!' AS prompt FROM conversations")
def prompts(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.prompt("Rate {{{role}}}: {text}!", role=F.col("role"), text=F.col("text")).alias("prompt"))


# ---- judge and logs

_ANSWERS = """SELECT event_id, CASE event_id % 9 WHEN 0 THEN props WHEN 1 THEN '{"rating": 4, "reason": "good", "error_examples": ["a", "b"]}' WHEN 2 THEN '```json' || chr(10) || '{"rating": 2}' || chr(10) || '```'
 WHEN 3 THEN '{"rating": 9}' WHEN 4 THEN '{"rating": 3.0}' WHEN 5 THEN '{"rating": true}' WHEN 6 THEN 'not json' WHEN 7 THEN '[1, 2]' ELSE '{"rating": 5, "reason": 7}' END AS answer FROM events"""


@query(f"""WITH a AS ({_ANSWERS}), b AS (SELECT event_id, CASE WHEN starts_with(answer, '```') THEN array_to_string(list_filter(string_split(answer, chr(10)), lambda x: NOT starts_with(x, '```')), chr(10)) ELSE answer END AS j FROM a),
c AS (SELECT event_id, CASE WHEN json_valid(j) THEN j END AS j FROM b),
e AS (SELECT *, CASE WHEN j IS NULL THEN 'not valid JSON' WHEN json_type(j) <> 'OBJECT' THEN 'not an object' WHEN json_type(j, '$.rating') IS NULL THEN 'missing rating'
 WHEN json_type(j, '$.rating') NOT IN ('UBIGINT', 'BIGINT') OR json_extract(j, '$.rating')::BIGINT NOT BETWEEN 1 AND 5 THEN 'rating must be an integer 1-5' WHEN json_type(j, '$.reason') <> 'VARCHAR' THEN 'reason must be a string' END AS error FROM c)
SELECT event_id, CASE WHEN error IS NULL THEN json_extract(j, '$.rating')::INT END AS rating, CASE WHEN error IS NULL THEN coalesce(json_extract_string(j, '$.reason'), '') END AS reason,
 CASE WHEN error IS NULL THEN coalesce(json_array_length(j, '$.error_examples'), 0)::INT END AS n_examples, error FROM e""")
def judge_parse(spark, sf_dir):
    k = F.col("event_id") % 9
    answers = ["", '{"rating": 4, "reason": "good", "error_examples": ["a", "b"]}', '```json\n{"rating": 2}\n```', '{"rating": 9}', '{"rating": 3.0}', '{"rating": true}', "not json", "[1, 2]"]
    answer = F.lit('{"rating": 5, "reason": 7}')
    for i, a in list(enumerate(answers))[:0:-1]:
        answer = F.when(k == i, a).otherwise(answer)
    parsed = table(spark, sf_dir, "events").select("event_id", judge.parse(F.when(k == 0, F.col("props")).otherwise(answer)).alias("p"))
    return parsed.select("event_id", "p.rating", "p.reason", F.when(F.col("p.error").isNull(), F.size("p.error_examples")).alias("n_examples"), "p.error")


@query("""SELECT event_id, event_id % 4 = 0 AS taken, 'k=' || json_extract_string(props, '$.k') || CASE WHEN event_id % 4 = 0 THEN '' ELSE ' user=' || user_id END AS extras, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events""")
def reserved_keys(spark, sf_dir):
    second = F.when(F.col("event_id") % 4 == 0, "level").otherwise("user")
    record = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), second, F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", logs.reserved_used(record).alias("taken"), logs.rendered(logs.extras_of(record)).alias("extras"), logs.utc(F.col("ts")).alias("at"))


@query("SELECT event_type, count(*) AS n_errors FROM events WHERE value > 10 GROUP BY event_type")
def errors_by_model(spark, sf_dir):
    return logs.errors_by(table(spark, sf_dir, "events"), "event_type", F.col("value") > 10)


@query("SELECT user_id, event_type FROM events GROUP BY ALL")
def distinct_keys(spark, sf_dir):
    return corpus.latest_of_each(table(spark, sf_dir, "events").select("user_id", "event_type"), ("user_id", "event_type"))
