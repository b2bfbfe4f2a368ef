import hashlib
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import bwt, jaccard, suffix_dedup
from scriptorium.llm.components import components
from scriptorium.llm.support import sized


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(ids, texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((str(d), len(s), str(d if not s else least.get(find(i)))) for i, (d, s) in enumerate(zip(ids, sets)))


def corpus(rng, groups=12):
    word = lambda: "".join(rng.choice("abcde") for _ in range(3))
    out = []
    common = [word() for _ in range(40)]
    for g in range(groups):
        base = [word() for _ in range(rng.choice([3, 6, 30, 80, 200]))] + (common if g % 2 else [])
        for _ in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = word()
            out.append(rng.choice([" ", "\n"]).join(copy))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_all_pairs(make_docs, nasty, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT", 4)
    monkeypatch.setattr(jaccard, "LIST", 3 if seed == 2 else 4096)
    texts = corpus(random.Random(seed)) + (nasty if seed == 1 else [])
    ids = random.Random(seed).sample(range(10_000), len(texts))
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard.join(make_docs(texts, ids)).collect())
    assert got == brute_components(ids, texts)


@pytest.mark.parametrize("sent", [0, 500_000])
def test_long_lists_meet_in_blocks(spark, monkeypatch, sent):
    monkeypatch.setattr(jaccard, "LIST", 7)
    monkeypatch.setattr(jaccard, "MAX_IDS", sent)
    rng = random.Random(3)
    rows = [(token, 100 * token + k, rng.randrange(9), rng.randint(40, 60), rng.randrange(9)) for token, m in enumerate([1, 2, 7, 8, 60]) for k in range(m)]
    may = lambda x, y: min(x[3], y[3]) * 100 >= max(x[3], y[3]) * 80 and all(180 * (r[3] - r[4]) >= 80 * (x[3] + y[3]) for r in (x, y))
    want = sorted((x[1], y[1]) for x in rows for y in rows if x[0] == y[0] and x[2] < y[2] and may(x, y))
    left = spark.createDataFrame(rows, "token long, rep long, comp long, n int, i int")
    got = sorted(tuple(r) for r in jaccard.within_lists(left, 80).collect())
    assert got == want and len(got) > 300


def test_large_near_copy_group(make_docs):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(100)]
    texts = []
    for _ in range(120):
        copy = list(base)
        for i in rng.sample(range(100), rng.randint(0, 5)):
            copy[i] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard.join(make_docs(texts)).collect())
    assert got == brute_components(list(range(120)), texts)


def test_repeated_and_null_ids(make_docs):
    a, b = "one two three four five six", "seven eight nine ten eleven"
    rows = jaccard.join(make_docs([a, a, a, b, b, None, "", "zz"], [3, 3, None, 9, 4, 5, 5, None])).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in rows) == sorted([("3", 2, "3"), ("3", 2, "3"), ("None", 2, "3"), ("9", 1, "4"), ("4", 1, "4"), ("5", 0, "5"), ("5", 0, "5"), ("None", 1, "None")])
    assert jaccard.join(make_docs([])).count() == 0
    docs = make_docs([a, a, a, b, b, None, ""], [3, 3, 8, 9, 4, 5, 6])
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 6]


def test_ids_that_repeat_over_texts(make_docs):
    """Ids on several texts, and null ids, against brute force; ids that aren't numbers, too."""
    rng = random.Random(3)
    texts = corpus(rng, 6) + [None, "", "a b"]
    ids = [rng.choice([None, *range(len(texts) // 3)]) for _ in texts]
    docs = make_docs(texts, ids)
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard.join(docs).collect())
    assert got == brute_components(ids, texts)
    named = docs.withColumn("doc_id", F.lpad(F.col("doc_id").cast("string"), 5, "0"))
    got = sorted((r["n_shingles"], str(r["component_id"])) for r in jaccard.join(named.filter("doc_id is not null")).collect())
    some = [(i, t) for i, t in zip(ids, texts) if i is not None]
    assert got == sorted((n, f"{int(c):05d}") for _, n, c in brute_components([i for i, _ in some], [t for _, t in some]))


def test_one_of_each_keeps_one_text_of_each_component(make_docs):
    """The rows (2,B) (5,A) (5,B+) (7,A+) (9,C) (9,A+): one of A, one of B, and C."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(2, b), (5, a), (5, b + " tail"), (7, a + " tail"), (9, c), (9, a + " tail")]
    docs = make_docs([t for _, t in rows], [i for i, _ in rows])
    assert sorted((r["doc_id"], r["text"]) for r in jaccard.one_of_each(docs).collect()) == [(2, b), (5, a), (9, c)]
    joined = sorted((r["doc_id"], r["component_id"]) for r in jaccard.join(docs).collect())
    assert joined == [(2, 2), (5, 2), (5, 5), (7, 5), (9, 5), (9, 9)]
    clashing = docs.withColumns({x: F.lit(1) for x in ("__id", "__row", "rank", "row", "kept", "id", "count")})
    assert jaccard.one_of_each(clashing).columns == clashing.columns and jaccard.join(clashing).count() == 6


def test_one_of_each_goes_by_text_not_by_id(make_docs):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    near = lambda t: t + " tail"
    rows = [(None, a), (None, a), (None, near(a)), (None, b), (5, c), (5, d), (5, ""), (5, ""), (None, None), (3, near(d)), (7, near(b)), (7, near(b))]
    docs = make_docs([t for _, t in rows], [i for i, _ in rows])
    kept = jaccard.one_of_each(docs)
    got = sorted(((str(r["doc_id"]), r["text"]) for r in kept.collect()), key=repr)
    first = [t for i, t in got if t in (a, near(a))]  # null ids alone: either text may stay
    assert kept.columns == docs.columns and len(first) == 1
    assert got == sorted([("None", first[0]), ("5", c), ("5", ""), ("5", ""), ("None", None), ("3", near(d)), ("7", near(b))], key=repr)


def test_hashes_of_slices():
    texts = corpus(random.Random(5)) + [None, "", "Ünï çødé A B C"] * 20
    whole = jaccard.distinct_sets(pa.array(texts))
    parts = [s for b in sized([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])], "text", 400) for s in jaccard.distinct_sets(b.column(0))]
    assert all((a == b).all() and len(a) == len(shingles(t)) for a, b, t in zip(whole, parts, texts, strict=True))


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 3000)).astype(np.uint64))
        b = np.unique(np.concatenate([rng.permutation(a)[: rng.integers(0, len(a) + 1)], rng.integers(0, 2**63, rng.integers(1, 600)).astype(np.uint64)]))
        assert jaccard.least_difference(jaccard.parity_bitmap(a), jaccard.parity_bitmap(b)) <= len(np.setxor1d(a, b))


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (200, 200)]
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(chain, "x long, y long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}


def test_merge_finds_repeated_intervals():
    rng = random.Random(3)
    for _ in range(60):
        letters = rng.choice([b"ab", b"abcdefgh", b"a"])
        strings = list({bytes(rng.choice(letters) for _ in range(rng.randint(5, 40))) for _ in range(rng.randint(1, 40))})
        values, depth = np.array([rng.randint(0, 9) for _ in strings]), 5
        got = bwt.interval_minima(np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings]), values, depth, rng.choice([10, 50, 10_000]))
        least, at = {}, 0
        for s, v in zip(strings, values):
            for i in range(len(s) - depth + 1):
                least[s[i : i + depth]] = min(least.get(s[i : i + depth], 99), v)
        for s in strings:
            want = [least[s[i : i + depth]] if i + depth <= len(s) else np.iinfo(np.int64).max for i in range(len(s))]
            assert got[at : at + len(s)].tolist() == want
            at += len(s)


def test_merge_keeps_shards_in_order():
    """Rows of a shard stay in order, and neighbours' common prefixes are those of their rotations."""
    parts = [[b"banana", b"bandana"], [b"ananas"], [b"cabana", b"nab"]]
    cycles = lambda p: bwt.Cycles(np.frombuffer(b"".join(p), np.uint8), np.array([len(s) for s in p]))
    orders, every = [bwt.build(cycles(p)) for p in parts], cycles([s for p in parts for s in p])
    for depth in (1, 2, 3, 8):
        merged = bwt.merge(every, orders, depth)
        rotations = [bytes(every.text[every.after(k)][i] for k in range(depth)) for i in merged.place]
        assert rotations == sorted(rotations)
        assert merged.common.tolist() == [0, *(len(os.path.commonprefix([a, b])) for a, b in zip(rotations, rotations[1:]))]
        base = 0
        for s, order in enumerate(orders):
            row = np.empty(len(order), int)
            row[order] = np.arange(len(order))
            assert (np.diff(row[merged.place[merged.shard == s] - base]) > 0).all()
            base += len(order)


def brute_removed(ids, texts, length=50):
    raw = [(t or "").encode() for t in texts]
    least = {}
    for d, t in zip(ids, raw):
        for p in range(len(t) - length + 1):
            if d is not None:
                k = t[p : p + length]
                least[k] = min(least.get(k, d), d)
    out = []
    for d, t in zip(ids, raw):
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if d is not None and least[t[p : p + length]] < d:
                gone[p : p + length] = b"\x01" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = len(re.findall(b"\x01+", bytes(gone)))
        out.append((str(d), len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_dedup_against_brute_force(make_docs, nasty, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", 4000)
    monkeypatch.setattr(suffix_dedup, "RANGE_BYTES", 6000)
    rng = random.Random(4)
    passages = ["".join(rng.choice("abc é\n") for _ in range(rng.choice([49, 50, 51, 80, 200]))) for _ in range(8)]
    texts = ["".join(rng.choice([*passages, "".join(rng.choice("abcdef ") for _ in range(rng.randint(0, 60)))]) for _ in range(rng.randint(0, 6))) for _ in range(80)]
    texts += [t for t in nasty if len(t or "") < 100_000] + ["a" * 300, "a" * 200, "b" + "a" * 60, "ab" * 100, "ba" * 40]
    ids = random.Random(9).sample(range(1000), len(texts) - 2) + [None, 3]
    docs = make_docs(texts, ids)
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.digest(suffix_dedup.dedup(docs)).collect())
    assert got == brute_removed(ids, texts)


def test_dedup_of_crowded_names(make_docs, monkeypatch):
    """One 20-byte string with thousands of contexts, more than a name may have segments, and texts in pieces."""
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", 20_000)
    monkeypatch.setattr(suffix_dedup, "RANGE_BYTES", 20_000)
    monkeypatch.setattr(suffix_dedup, "CROWD", 30)
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefghijk") for _ in range(n))
    tails = [word(60) for _ in range(5)]
    texts = [word(rng.randint(0, 80)) + "-" * rng.randint(15, 70) + rng.choice([*tails, word(40)]) for _ in range(400)]
    texts += ["ab" * 300, "ba" * 400, "-" * 500, *texts[:30]]
    ids = rng.sample(range(10_000), len(texts))
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.digest(suffix_dedup.dedup(make_docs(texts, ids))).collect())
    assert got == brute_removed(ids, texts)


@pytest.mark.parametrize("piece", [64, 100, 1 << 17])
def test_segments_hold_every_window_once(monkeypatch, piece):
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    rng = random.Random(2)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.choice([0, 1, 49, 50, 51, 120, 300]))) for _ in range(60)]
    ends = np.cumsum([len(t) for t in texts])
    found = suffix_dedup.segments(np.frombuffer(b"".join(texts), np.uint8), ends, hashed=True)
    windows, names = [], {}
    for name, d, s, z, h in zip(found.names.tolist(), found.texts, found.starts, found.sizes, map(tuple, found.hashes.tolist()), strict=True):
        own = texts[d][s - ends[d] + len(texts[d]) :][:z]
        assert len(own) == z and names.setdefault(own, h) == h
        for k in range(z - 49):
            windows.append((d, s + k))
            assert names.setdefault((own[k : k + 50],), name) == name
    assert sorted(windows) == [(d, ends[d] - len(t) + i) for d, t in enumerate(texts) for i in range(len(t) - 49)]


def test_dedup_of_repeated_rows(make_docs):
    long = "".join(random.Random(6).choice("abcdefgh") for _ in range(120))
    texts, ids = [long, long, "x" + long, long + "y", "", None, long[:49]], [5, 5, 5, 9, 1, 2, 8]
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.digest(suffix_dedup.dedup(make_docs(texts, ids))).collect())
    assert got == brute_removed(ids, texts)
    assert suffix_dedup.dedup(make_docs([])).count() == 0
