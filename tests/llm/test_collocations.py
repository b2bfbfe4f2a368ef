import random
import re
from collections import Counter

import pytest

from scriptorium.llm import collocations


def pieces(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lowered)]


def brute(rows, longest=3, least=10, top=2000, percent=50):
    """rows: (lang, text)."""
    counts, out = {}, []
    for lang, text in rows:
        own = counts.setdefault(lang or "und", Counter())
        for p in pieces(text):
            own.update(tuple(p[i : i + k]) for k in range(1, longest + 1) for i in range(len(p) - k + 1))
    for lang, f in counts.items():
        n, found = sum(c for p, c in f.items() if len(p) == 1), []
        frequent = {p: c for p, c in f.items() if c >= least}
        for p, a in frequent.items():
            if len(p) < 2:
                continue
            inside = [c for q, c in frequent.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * c >= percent * a for c in inside):
                continue
            score, _, l, r = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return sorted(out)


def cases():
    rng = random.Random(6)
    words = ["the", "The", "of", "é", "漢", "x-y", "\x00", "a", "b", "c"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", ". ", "\n", "\x0b", "?"] if rng.random() < 0.3 else [" "]) for _ in range(n))
    rows = [(rng.choice(["en", "fr", None, "und"]), text(rng.randint(0, 40))) for _ in range(300)]
    return rows + [("en", None), ("en", ""), ("de", " \t. "), ("en", "the same line over and over"), ("fr", "one two " * 400), (None, "z" * 50_000)] + [("es", "rosa del viento")] * 12


def table(spark, rows):
    return spark.createDataFrame([(lang, t, "x", 1) for lang, t in rows], "lang string, text string, word string, n int").repartition(5)


def rows_of(df):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect())


@pytest.mark.parametrize(("longest", "least"), [(2, 10), (3, 10), (4, 3)])
def test_against_brute_force(spark, longest, least):
    rows = cases()
    assert rows_of(collocations.collocations(table(spark, rows), longest=longest, least=least)) == brute(rows, longest, least)


def test_first_ones_with_ties(spark):
    rows = cases()
    assert rows_of(collocations.collocations(table(spark, rows), top=4)) == brute(rows, top=4)


@pytest.mark.parametrize("seen", [4096, 8])
def test_dealt_prefixes_and_pairs_count_the_same(spark, monkeypatch, seen):
    """Almost every prefix goes to several tasks, and so do the pairs that a batch holds often."""
    monkeypatch.setattr(collocations, "SEEN", seen)
    rows = [*cases(), *[("en", f"of the w{i} of the w{i % 7}") for i in range(600)]]
    for longest in (2, 3, 4):
        _, counts = collocations.phrase_counts(table(spark, rows), "text", "lang", longest, 10, share=20)
        _, plain = collocations.phrase_counts(table(spark, rows), "text", "lang", longest, 10)
        found = lambda c: sorted((r["lang"], tuple(r["phrase"]), r["n"]) for r in c.collect())
        assert found(counts) == found(plain) and len({p for _, p, _ in found(counts)}) > 50


def test_shared_codes_are_drawn_anew(spark, monkeypatch):
    import numpy as np

    real = collocations.codes
    monkeypatch.setattr(collocations, "codes", lambda words, draw: real(words, draw) if draw else np.full(len(words), 5, np.uint64))
    rows = cases()
    assert rows_of(collocations.collocations(table(spark, rows))) == brute(rows)


def test_no_rows(spark):
    assert collocations.collocations(table(spark, [])).count() == 0


def test_products_beyond_64_bits(spark):
    big = 4_000_000_000_000
    counts = spark.createDataFrame([("en", [1], big), ("en", [2], big + 1), ("en", [1, 2], big - 1)], "lang string, phrase array<long>, n long")
    (row,) = collocations.worst_cuts(counts).collect()
    assert row["score"] == 1_000_000 * (big - 1) ** 2 // (big * (big + 1))
