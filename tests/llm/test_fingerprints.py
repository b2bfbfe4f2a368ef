import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from scriptorium.llm import fingerprints
from tests.llm.conftest import prose


def shingles(text, size=5):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\x0b", " ").replace("\x0c", " ").split()
    return {" ".join(w[i : i + size]) for i in range(max(len(w) - size + 1, min(len(w), 1)))}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a or b else 1.0


def like(a, b):
    x, y = fingerprints.packed(pa.array([a])), fingerprints.packed(pa.array([b]))
    return float(fingerprints.likeness(x[0], y[0], x[1], y[1])[0])


def test_estimates_follow_the_similarity():
    rng, errors = random.Random(1), []
    for _ in range(150):
        words = prose(rng, rng.choice([6, 20, 60, 300, 1500])).split()
        other = [w if rng.random() > rng.choice([0, 0.01, 0.05, 0.3]) else prose(rng, 1) for w in words]
        a, b = " ".join(words), " ".join(other)
        errors.append(like(a, b) - jaccard(a, b))
    assert max(map(abs, errors)) < 0.09 and abs(np.mean(errors)) < 0.01


def test_unlike_texts_agree_only_by_chance_whatever_their_size():
    rng = random.Random(2)
    found = [like(prose(rng, n), prose(rng, m)) for n, m in ((1, 1), (2, 900), (7, 6), (40, 30), (800, 900)) for _ in range(8)]
    assert max(found) < 0.08 and like("a b", "A  B") == 1.0 and like("", " \n") == 1.0 and like("", "a") == 0.0


def test_densification_against_its_definition():
    rng = np.random.default_rng(4)
    table = np.full((40, 64), fingerprints._EMPTY)
    for d, row in enumerate(table[1:], 1):
        row[rng.choice(64, d, replace=False)] = rng.integers(0, 1 << 60, d).astype(np.uint64)
    turn, _ = fingerprints.bin_orders(64)
    got = fingerprints.densified(table)
    for d in range(1, 40):
        for b in range(64):
            first = b if table[d, b] != fingerprints._EMPTY else next(s for s in turn[b] if table[d, s] != fingerprints._EMPTY)
            assert got[d, b] == table[d, first]
    assert (got[0] == fingerprints._EMPTY).all()


def brute(rows):
    """(id, edited text, own likeness to it, to the next one's) by the rows' defined order, which hashes only decide among equal ids."""
    out = []
    for i, (name, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1] or ""
        t = t or ""
        third = len(t) // 3
        made = t[: len(t) - third] + after[:third]
        out.append((name, len(t), hashlib.sha256(made.encode()).hexdigest(), like(t, made), like(t, after)))
    return out


def test_edited_against_brute_force(spark, make_docs, nasty):
    ids = random.Random(3).sample(range(1000), len(nasty))
    docs = make_docs(nasty, ids).repartition(5)
    want = brute(sorted(zip(ids, nasty, strict=True), key=lambda r: -r[0]))
    for partitions in ("1", "4", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        got = sorted((r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in fingerprints.edited(docs).collect())
        assert got == sorted(want)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    rows = fingerprints.digest(fingerprints.edited(docs)).collect()
    by_text = {}
    for r in rows:
        by_text.setdefault(nasty[ids.index(r["doc_id"])], set()).add(r["fingerprint"])
    assert all(len(f) == 1 for f in by_text.values())


def test_repeated_null_and_few_ids(spark, make_docs):
    docs = make_docs(["b c", "b c", "d e f", None, "g h i j k l"], [7, 7, None, None, 9])
    rows = fingerprints.edited(docs).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["7", "7", "9", "None", "None"]
    nine = next(r for r in rows if r["doc_id"] == 9)
    assert nine["edited_sha256"] == hashlib.sha256(b"g h i j b c").hexdigest()
    assert sorted(r["near_next"] == 1.0 for r in rows if r["doc_id"] == 7) == [False, True]
    (one,) = fingerprints.edited(make_docs(["abc def"])).collect()
    assert one["edited_sha256"] == hashlib.sha256(b"abc dab").hexdigest() and one["near_next"] == 1.0
    assert fingerprints.edited(make_docs([])).count() == 0


def test_fingerprints_as_a_column(spark, make_docs, nasty):
    docs = fingerprints.fingerprints(make_docs(nasty).withColumn("fingerprint", F.lit(1)))
    assert docs.columns.count("fingerprint") == 1
    pairs = docs.alias("a").join(docs.alias("b")).select("a.doc_id", F.col("b.doc_id").alias("other"), fingerprints.alike(F.col("a.fingerprint"), F.col("b.fingerprint")).alias("s"))
    for r in pairs.collect():
        assert abs(r["s"] - jaccard(nasty[r["doc_id"]], nasty[r["other"]])) < 0.09
