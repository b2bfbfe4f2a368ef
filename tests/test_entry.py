import math
import random
import unicodedata
from difflib import SequenceMatcher
from itertools import combinations

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from scriptorium.plans.inputs import scores_sql
from scriptorium.plans.queries import ORACLES, QUERIES
from tests.test_functions import table_distance

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NA or v != v:
        return "-"
    if isinstance(v, bool) or type(v).__name__ == "bool":
        return str(bool(v))
    return f"{v:.6g}" if isinstance(v, float) or type(v).__name__.startswith("float") else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    assert len(got)
    if name in ORACLES:
        want = con.sql(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        order = sorted(got.columns)
        as_rows = lambda df: sorted(tuple(map(plain, r)) for r in df[order].itertuples(index=False, name=None))
        assert as_rows(got) == as_rows(want)


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())


def test_cost_per_point_of_cells_that_tie(spark, tmp_path):
    """Without an ``a`` two cells make the same edits, so neither gains on the other, however their rows are dealt."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["the", "then", "with", "of", "moth", "her"]) for _ in range(rng.randrange(1, 30))) for _ in range(300)]
    pages = spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    pages.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = {(r["model"], r["preprocessing"]): r["cost_per_point"] for r in QUERIES["cost_per_point"](spark, str(tmp_path)).collect()}
    assert got["claude", "raw"] is None and got["tesseract", "raw"] is None
    assert got == {(m, p): c for m, p, c in con.sql(ORACLES["cost_per_point"]).fetchall()}


def test_document_cer(spark, sf_dir):
    """The corruption only deletes, so the distance is what it deletes, for documents of any length."""
    docs = {r["doc_id"]: unicodedata.normalize("NFC", r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["doc_id"]: r["cer"] for r in QUERIES["document_cer"](spark, sf_dir).collect()}
    assert set(got) == {d for d, t in docs.items() if t.strip()}
    for d, cer in got.items():
        assert cer == pytest.approx(docs[d].count("th") / len(docs[d]), abs=1e-6)
    for d in random.Random(1).sample([d for d in got if len(docs[d]) < 1200], 6):
        assert got[d] == pytest.approx(table_distance(docs[d], docs[d].replace("th", "t")) / len(docs[d]), abs=1e-6)


@pytest.fixture(scope="module")
def cells(spark, sf_dir):
    """(page, cell) -> (reference, text) of the benchmark's matrix."""
    from scriptorium.plans import inputs

    truth = inputs.benchmark_truth(spark, sf_dir)
    refs = {(r["book_id"], r["page_id"]): r["ref"] for r in truth.collect()}
    return {(r["book_id"], r["page_id"], r["model"], r["preprocessing"]): (refs[r["book_id"], r["page_id"]], r["text"]) for r in inputs.transcriptions(truth).collect()}


def test_error_categories(spark, sf_dir, cells):
    """A plain walk over opcodes; all texts are ASCII, so white space and the rest are all there is beside bursts."""
    want: dict = {}
    for (_, _, model, preprocessing), (ref, text) in cells.items():
        for kind, i, j, k, m in SequenceMatcher(None, ref, text, autojunk=False).get_opcodes():
            if kind == "equal":
                continue
            gone, came = ref[i:j], text[k:m]
            units = [("omission_burst", 1)] * (len(gone) >= 8) + [("hallucination_burst", 1)] * (len(came) >= 8) or [("whitespace" if (gone + came).isspace() else "latin_punctuation", max(len(gone), len(came)))]
            for name, n in units:
                want[model, preprocessing, name] = want.get((model, preprocessing, name), 0) + n
    got = {(r["model"], r["preprocessing"], r["category"]): r["count"] for r in QUERIES["error_categories"](spark, sf_dir).collect()}
    assert {k: v for k, v in got.items() if v} == want


@pytest.fixture(scope="module")
def agreements(cells):
    """(book, page) -> mean similarity of its cells' texts in the order of their names."""
    pages: dict = {}
    for (book, page, model, preprocessing), (_, text) in cells.items():
        pages.setdefault((book, page), []).append((f"{model}_{preprocessing}", text))
    ratios = lambda own: [SequenceMatcher(None, a, b).ratio() for (_, a), (_, b) in combinations(sorted(own), 2)]
    return {key: sum(found) / len(found) for key, own in pages.items() if (found := ratios(own))}


def test_page_agreement(spark, sf_dir, agreements):
    got = {(r["book_id"], r["page_id"]): r["agreement"] for r in QUERIES["page_agreement"](spark, sf_dir).collect()}
    assert got == {key: pytest.approx(x, abs=1e-6) for key, x in agreements.items()}


def test_agreement_calibration(spark, sf_dir, con, agreements):
    """Scores by DuckDB, similarities by difflib, ranks by pandas."""
    scores = con.sql(scores_sql("benchmark") + " SELECT book_id, page_id, model, preprocessing, cer FROM s").df()
    scores["rating"] = (5 - (scores["cer"] * 10).apply(math.floor)).clip(lower=1).astype(float)
    pages = scores.groupby(["book_id", "page_id"])["cer"].mean()
    together = pd.DataFrame({"a": [agreements[k] for k in pages.index], "c": pages.to_numpy()})
    spearman = lambda x, y: x.rank().corr(y.rank())
    want = {"spearman_fluency_vs_cer": spearman(scores["rating"], scores["cer"]), "pearson_fluency_vs_cer": scores["rating"].corr(scores["cer"]), "spearman_agreement_vs_mean_cer": spearman(together["a"], together["c"]), "pearson_agreement_vs_mean_cer": together["a"].corr(together["c"])}
    want |= {f"spearman_{m}_{p}": spearman(g["rating"], g["cer"]) for (m, p), g in scores.groupby(["model", "preprocessing"])}
    got = {r["metric"]: r["value"] for r in QUERIES["agreement_calibration"](spark, sf_dir).collect()}
    assert set(got) == set(want)
    for metric, value in want.items():
        assert (got[metric] is None) if value != value else got[metric] == pytest.approx(value, abs=1e-5), metric
