import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from scriptorium.llm import bpe, queries, sharding, topk


def brute_shards(rows, limit):
    key = lambda i, t: int(hashlib.md5(f"{'' if i is None else i}\x1f{t or ''}".encode()).hexdigest()[:15], 16)
    items = [(key(i, t), len((t or "").encode())) for i, t in rows]
    out = {}

    def split(part, depth, bits):
        if sum(b for _, b in part) <= limit or len({k for k, _ in part}) == 1:
            for k, _ in part:
                out[k] = (bits, sum(b for _, b in part), len(part))
            return
        for bit in (0, 1):
            below = [(k, b) for k, b in part if (k >> (sharding.BITS - depth - 1)) & 1 == bit]
            if below:
                split(below, depth + 1, bits + str(bit))

    if items:
        split(items, 0, "")
    return [out[key(i, t)] for i, t in rows]


@pytest.mark.parametrize("limit", [0, 300, 2000, 10**9])
def test_shards_match_a_plain_directory(make_docs, nasty, limit):
    texts = nasty + [f"text {i} " * (i % 7) for i in range(150)] + ["same"] * 3
    ids = [*range(len(texts) - 3), 5000, 5001, None]
    want = brute_shards(list(zip(ids, texts)), limit)
    got = sharding.shards(make_docs(texts, ids), limit=limit).collect()
    assert sorted((str(r["doc_id"]), r["shard"], r["shard_bytes"], r["shard_rows"]) for r in got) == sorted((str(i), *w) for i, w in zip(ids, want))
    assert all(r["overflow"] == (r["shard_bytes"] > limit) and r["depth"] == len(r["shard"]) for r in got)


@pytest.mark.parametrize("sent", [0, 250_000])
def test_repeated_rows_fit_their_shards(spark, make_docs, tmp_path, monkeypatch, sent):
    monkeypatch.setattr(sharding, "MAX_SENT", sent)
    texts = [f"text {i} " * 5 for i in range(60)] + ["again and again"] * 300 + [None] * 40 + ["long " * 100] * 2
    ids = [*range(60), *[77] * 300, *[None] * 40, 78, 78]
    got = sharding.shards(make_docs(texts, ids), limit=400).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"]) for r in got) == sorted((str(i), len(t or "")) for i, t in zip(ids, texts))
    by_shard = {}
    for r in got:
        by_shard.setdefault(r["shard"], []).append(r)
    for name, rows in by_shard.items():
        total = sum(r["n_bytes"] for r in rows)
        assert total <= 400 or len(rows) == 1
        assert {(r["shard_bytes"], r["shard_rows"], r["overflow"], r["depth"]) for r in rows} == {(total, len(rows), total > 400, len(name))}
    names = sorted(by_shard)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
    directory = sharding.write_shards(make_docs(texts, ids), str(tmp_path / "s"), limit=400)
    back = spark.read.schema("doc_id long, text string, __shard string").parquet(str(tmp_path / "s"))
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in back.collect()) == sorted((str(i), t or "") for i, t in zip(ids, texts))
    sizes = {r["shard"]: (r["shard_bytes"], r["shard_rows"]) for r in directory.collect()}
    held = back.groupBy("__shard").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("b"), F.count("*").alias("n")).collect()
    assert sizes == {r["__shard"]: (r["b"], r["n"]) for r in held}


def test_written_shards_hold_every_row(spark, make_docs, nasty, tmp_path):
    assert sharding.shards(make_docs([])).count() == 0
    directory = sharding.write_shards(make_docs(nasty), str(tmp_path / "s"), limit=5000)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == len(nasty)
    assert back.select("__shard").distinct().count() == directory.filter("shard_rows > 0").count()


@pytest.fixture(scope="module")
def encoding():
    return bpe.make_encoding(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read(), public_tokenizers.PATTERN)


def test_round_trip(spark, make_docs, nasty, encoding):
    texts = nasty + ["<|endoftext|> don't   stop\n\n  x", " " * 300 + "y"]
    got = {r["doc_id"]: r for r in queries.round_trip(make_docs(texts), queries.tokenizer(spark)).collect()}
    for i, t in enumerate(texts):
        ids = encoding.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_cuts_change_nothing(encoding, monkeypatch):
    monkeypatch.setattr(bpe, "LONG", 30)
    monkeypatch.setattr(bpe.pieces, "__defaults__", (30,))
    rng = random.Random(2)
    parts = [" ", "  ", "\n", "a", "Bc", "é", "1", "!", "'s", "\t", "\x1c", " ", "漢", "don't"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 200)))
        assert bpe.encode_text(encoding, text) == encoding.encode_ordinary(text), repr(text)


def test_extreme_runs(encoding):
    for text in ("a" * 300_000, " " * 1_500_000 + "x", "\n" * 1_500_000, "ab " * 100_000, "y" + " " * 1_200_000 + "z " * 30_000):
        ids = bpe.encode_text(encoding, text)
        assert encoding.decode_bytes(ids) == text.encode()
    assert bpe.encode_text(encoding, " " * 60_000 + "x") == encoding.encode_ordinary(" " * 60_000 + "x")


def test_decode_of_unknown_ids(spark, make_docs):
    ranks = queries.tokenizer(spark)
    rows = spark.createDataFrame([([0, 1],), ([60_000],), (None,), ([],)], "ids array<int>")
    assert sorted(str(r["decoded"] and bytes(r["decoded"])) for r in bpe.decode(rows, ranks).collect()) == sorted(["None", "None", repr(b'!"'), repr(b"")])
    assert bpe.encode(make_docs([]), ranks).count() == 0
    assert isinstance(ranks.encoding(), tiktoken.Encoding)


def brute_top(rows, k=5):
    good = [(i, np.floor(256 * np.array(v, dtype=np.float64)).astype(np.int64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in {i: v for i, v in good if i % 50 == 0}.items():
        scores = sorted((-int((a * b).sum()), i) for i, b in good if i != q and len(b) == len(a))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return sorted(out)


def search(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, query_id int, rank int, v int")
    return sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect())


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 150)
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(500)]
    rows += [(500 + i, rows[3][1]) for i in range(100)]  # ties
    rows += [(700, None), (701, []), (702, [float("nan")] * 8), (703, [1.0, None] * 4), (704, [float("inf")] * 8), (750, [1.0, 2.0]), (751, [1.0, 3.0]), (None, [1.0] * 8)]
    assert search(spark, [(*r, 0, 0, 0) for r in rows]) == brute_top(rows)


def test_top_k_of_lengths_that_the_sample_misses(spark, monkeypatch):
    monkeypatch.setattr(topk, "PIVOT_SAMPLE", 20)
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(400)]
    rows += [(1000 + i, [float(np.float32(x)) for x in rng.normal(size=n)]) for n in range(2, 8) for i in range(n * 50, n * 50 + 3)]
    assert search(spark, [(*r, 0, 0, 0) for r in rows]) == brute_top(rows)


def test_top_k_small_and_large_values(spark):
    assert search(spark, []) == []
    assert search(spark, [(0, [1.0], 0, 0, 0)]) == []
    rows = [(i, [3e9 * (i + 1), -2e9, 1.0]) for i in range(4)]
    big = [(i, np.array([int(np.floor(256 * float(np.float32(x)))) for x in v], dtype=object)) for i, v in rows]
    want = sorted(((-sum(int(a) * int(b) for a, b in zip(big[0][1], v))), i) for i, v in big[1:])
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    assert [(r[2], r[3]) for r in search(spark, [(*r, 0, 0, 0) for r in rows])] == sorted(((i, clip(-s)) for s, i in want), key=lambda x: (-x[1], x[0]))


def clustered(rng, n=2000, clusters=8, dim=8):
    centres = rng.normal(size=(clusters, dim)) * 8
    return [(i, [float(np.float32(x)) for x in centres[i % clusters] + rng.normal(size=dim) / 20]) for i in range(n)]


def test_top_k_of_clusters_in_many_cells(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 40)
    monkeypatch.setattr(topk, "PIVOT_SAMPLE", 300)
    rows = clustered(np.random.default_rng(8), 600)
    rows += [(50, rows[7][1]), (50, rows[7][1]), *[(9, rows[0][1])] * 40]  # repeated ids and rows
    distinct = [(i, list(v)) for i, v in dict.fromkeys((i, tuple(v)) for i, v in rows)]
    queries = {}
    for i, v in distinct:
        if i % 50 == 0:
            queries[i] = min(queries.get(i, v), v, key=lambda v: np.floor(256 * np.array(v)).tolist())
    want = []
    ints = [(i, np.floor(256 * np.array(v)).astype(np.int64)) for i, v in distinct]
    for q, v in queries.items():
        a = np.floor(256 * np.array(v)).astype(np.int64)
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted((-int(a @ b), i) for i, b in ints if i != q)[:5])]
    assert search(spark, [(*r, 0, 0, 0) for r in rows]) == sorted(want)


def test_clusters_leave_most_candidates_unread(monkeypatch):
    rng = np.random.default_rng(9)
    x = np.floor(256 * np.array([v for _, v in clustered(rng)])).astype(np.int64)
    ids, sample = np.arange(len(x)), np.arange(0, len(x), 5)
    pivots = topk.choose_pivots(x[sample].astype(float), topk.PIVOTS)
    table, norm = topk.distances(x.astype(float), pivots), (x.astype(float) ** 2).sum(axis=1)
    region = table.argmin(axis=1)
    bounds = {r: topk.Region(table[region == r].min(axis=0), table[region == r].max(axis=0), norm[region == r].max(), 1) for r in set(region.tolist())}
    queries = np.arange(0, len(x), 50)
    floor = topk.floors(x[queries], queries, ids[sample], x[sample], 5)
    seen, product = [], topk.products
    monkeypatch.setattr(topk, "products", lambda c, q: seen.append(len(c)) or product(c, q))
    sent = 0
    for q, least in zip(queries, floor):
        open_ = [r for r, b in bounds.items() if topk.reach(table[[q]], norm[[q]], np.array([least]), b)[0]]
        inside = np.flatnonzero(np.isin(region, open_))
        sent += len(inside)
        found, scores = topk.search(x[q], q, table[q], x[inside], ids[inside], table[inside], norm[inside], 5, int(least))
        assert list(zip(-scores, found)) == sorted((-int(x[q] @ x[i]), i) for i in ids if i != q)[:5]
    assert sent < 0.5 * len(x) * len(queries) and sum(seen) < 0.25 * len(x) * len(queries)
