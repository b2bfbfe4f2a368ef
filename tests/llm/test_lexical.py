import math
import random
import re
from collections import Counter

import pytest

from scriptorium.llm import lexical


def terms(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, k=10):
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    n, total = len(held), sum(x for *_, x in held)
    df = Counter(w for _, c, _ in held for w in c)
    out = []
    for name, text in dict.fromkeys(items):
        found = []
        for i, c, size in held:
            m = 10 + 90 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in set(terms(text)) if w in c)
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(name, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def cases():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)] + ["É", "Ab", "x1", "漢"]
    text = lambda n: "".join(words[min(int(rng.expovariate(0.08)), 63)] + rng.choice([" ", "\n", "-", "\x00", "_"]) for _ in range(n))
    docs = [text(rng.randint(0, 50)) for _ in range(400)] + ["same words here"] * 30 + [None, "", " - ", text(20_000)]
    items = [(i, text(rng.randint(1, 12))) for i in range(25)] + [(100, "same"), (100, "here w1"), (100, "same"), (101, None), (102, ""), (None, "w2 É é"), (103, "nowhere")]
    return docs, items


def rows_of(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("all_terms", [False, True])
def test_against_brute_force(spark, make_docs, nasty, monkeypatch, all_terms):
    """With the items' terms alone in the index, and with all."""
    if all_terms:
        monkeypatch.setattr(lexical, "MAX_TERMS", 3)
    docs, items = cases()
    docs = docs + nasty
    ids = [*range(len(docs) - 2), None, 5]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(lexical.search(make_docs(docs, ids), bench)) == brute(list(zip(ids, docs, strict=True)), items)


def test_blocks_and_small_windows_give_the_same(spark, make_docs, monkeypatch):
    docs, items = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(list(enumerate(docs)), items, 3)
    for window, most in ((7, 1 << 20), (8192, 40)):
        real = lexical.index
        monkeypatch.setattr(lexical, "index", lambda *a, real=real, w=window, m=most: real(*a, window=w, most=m))
        assert rows_of(lexical.search(make_docs(docs), bench, 3, block_bytes=300)) == want
        monkeypatch.setattr(lexical, "index", real)


def test_names_of_columns_and_empty_inputs(spark, make_docs):
    bench = spark.createDataFrame([(1, "a b")], "q long, body string")
    docs = make_docs(["a x", "y z", "b a", None]).withColumnRenamed("doc_id", "name")
    got = lexical.search(docs.withColumnRenamed("text", "words"), bench, doc_id="name", text="words", item_id="q", item_text="body").collect()
    assert [(r["q"], r["rank"], r["name"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1, 2), (1, 2, 0)]
    plain = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.search(make_docs([]), plain).count() == 0 and lexical.search(make_docs([None, ""]), plain).count() == 0
    assert lexical.search(make_docs(["a"]), plain.limit(0)).count() == 0
