import re

import duckdb
import pytest

import corpus_pipeline
from scriptorium.llm import langid, queries
from scriptorium.llm.oracles import ORACLES

from .test_decontaminate import brute as brute_windows
from .test_near_duplicates import brute_components
from .test_secrets import brute as brute_secrets


def test_stages_against_brute_force(spark, sf_dir, tmp_path):
    """Every stage on what the one before kept."""
    docs = queries.read(spark, sf_dir, "documents")
    columns = docs.columns
    items = [(r["item_id"], r["text"]) for r in queries.read(spark, sf_dir, "benchmark").collect()]
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = dict(kept)
        stage(spark, docs, sf_dir).write.parquet(path := str(tmp_path / str(k)))
        docs = spark.read.parquet(path)
        kept = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert docs.columns == columns and kept.items() <= before.items()
        if name == "language":
            assert set(kept) == {d for d, t in before.items() if re.search(r"[^\W\d_]", t or "")}
        elif name == "near_duplicates":
            assert set(kept) == {int(d) for d, _, c in brute_components(list(before), list(before.values())) if d == c}
        elif name == "decontaminate":
            assert set(kept) == {d for d, t in before.items() if not brute_windows(t, items)[1]}
        elif name == "secrets":
            assert set(kept) == {d for d, t in before.items() if not brute_secrets(t)}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r["doc_id"] for r in last.collect()} == set(kept)
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, last.collect()))


def test_stages_on_awkward_rows(spark, sf_dir, make_docs, nasty, tmp_path):
    for k, texts in enumerate((nasty + nasty[:3], [])):
        docs = make_docs(texts, [*range(len(nasty)), None, 5, None][: len(texts)])
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, sf_dir).write.parquet(path := str(tmp_path / f"{k}-{n}"))
            docs = spark.read.parquet(path)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf_dir).toPandas()
    want = con.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    plain = lambda df: sorted(tuple(map(str, r)) for r in df[order].itertuples(index=False, name=None))
    assert plain(got) == plain(want)


def test_every_operator_has_its_query():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES} == set(range(1, 14))
    assert len(langid.default_vocabulary()) > 5000
