import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import langid, quality, queries
from scriptorium.llm.support import sized


def test_quality_on_held_out_rows(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs, labels).join(labels, "doc_id").toPandas()
    assert set(rows["held_out"]) == {True, False}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows.itertuples())
    held = rows[rows["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.95
    assert rows["score"].between(0, 1).all() and ((rows["score"] >= 0.3) == (rows["predicted"] == 1)).all()


def plain_features(text):
    """The features of a text, one after the other."""
    text = text or ""
    raw = text.encode()
    size = max(len(raw), 1)
    of = lambda chars: sum(raw.count(c) for c in chars.encode())
    shares = [raw.count(b) / size for b in set(raw)]
    words = [w.decode() for w in raw.split()]
    lines = text.split("\n")
    n = max(len(words), 1)
    upper, lower = of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), of("abcdefghijklmnopqrstuvwxyz")
    punctuation = [b for b in raw if 32 < b < 127 and not chr(b).isalnum()]
    return [
        math.log1p(len(raw)), upper / max(upper + lower, 1), of("0123456789") / size, len(punctuation) / size, of("|") / size, of("#$%&*@^~<>{}[]\\=+_") / size, of("!?") / size, of(".,;:") / size, of("\n") / size,
        of(" \t\r\n\x0b\x0c") / size, sum(b >= 128 for b in raw) / size, max(shares, default=0), -sum(p * math.log2(p) for p in shares), sum(map(len, words)) / n, sum(len(w) <= 3 for w in words) / n,
        len(set(words)) / n if words else 1.0, len(set(lines)) / len(lines), len(words) / len(lines),
    ]


def test_quality_query_matches_plain_python(spark, sf_dir, nasty):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    rows = docs.select("doc_id", "text").collect()
    x = quality.features(pa.array([r["text"] for r in rows] + nasty))
    assert np.allclose(x, [plain_features(t) for t in [r["text"] for r in rows] + nasty], rtol=1e-9, atol=1e-9)
    got = {r["doc_id"]: r for r in queries.op3_quality(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for r, values in zip(rows, x.tolist()):
        place = lambda cuts, k: sum(c <= values[k] for c in cuts)  # noqa: B023, E731
        total = model.intercept + sum(t[place(c, k)] for k, (c, t) in enumerate(zip(model.cuts, model.tables))) + sum(t[place(model.coarse[i], i)][place(model.coarse[j], j)] for i, j, t in model.pairs)
        score = 1 / (1 + math.exp(-min(max(total, -30), 30)))
        found = got[r["doc_id"]]
        assert math.isclose(found["score"], score, rel_tol=1e-9) and found["predicted"] == int(found["score"] >= 0.3)
        assert found["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_quality_is_additive():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.fit(x, y)
    assert ((model.score(x) > 0.5) == (y > 0)).mean() > 0.95  # only a pair of features tells
    by_hand = model.intercept + sum(t[np.searchsorted(c, x[0, k], side="right")] for k, (c, t) in enumerate(zip(model.cuts, model.tables))) + sum(t[np.searchsorted(model.coarse[i], x[0, i], side="right"), np.searchsorted(model.coarse[j], x[0, j], side="right")] for i, j, t in model.pairs)
    assert np.isclose(model.score(x[:1])[0], 1 / (1 + np.exp(-by_hand)))


def test_quality_cases(spark, make_docs, nasty):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(10)] + [(3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.classify(make_docs(nasty), labels).count() == len(nasty)
    none = labels.filter("false")
    assert {r["score"] for r in quality.classify(make_docs(nasty), none).collect()} == {0.5}
    assert quality.classify(make_docs([]), labels).count() == 0


def test_features_of_slices(nasty):
    whole = quality.features(pa.array(nasty))
    parts = np.concatenate([quality.features(b.column(0)) for b in sized([pa.RecordBatch.from_arrays([pa.array(nasty)], names=["text"])], "text", 500)])
    assert np.allclose(whole, parts) and np.isfinite(whole).all()


@pytest.fixture(scope="module")
def names():
    return langid.default_vocabulary()


def test_language_on_held_out_rows(spark, sf_dir, names):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    rows = langid.identify(docs, names).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows.itertuples())
    held = rows[rows["held_out"]]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.97
    assert rows["score"].between(0, 1).all()


SMALL = ["▁", "▁a", "a", "b", "ab", "ba", "▁ab", "bab"]
BYTES = [f"<0x{b:02X}>" for b in range(256)]


def brute(names, table, word, wanted=None):
    """The probability of a word in each language by all its segmentations; and the expected count of each piece in language 0."""
    column = {n: i for i, n in enumerate(names)}
    total, counts = np.zeros(table.shape[1]), np.zeros(len(names) + 1)

    def walk(at, p, used):
        nonlocal total, counts
        if at == len(word):
            total = total + p
            for i in used:
                counts[i] += p[0]
            return
        for k in range(1, len(word) - at + 1):
            part = word[at : at + k]
            if part in column:
                own = [column[part]]
            elif k == 1:
                own = [column[f"<0x{b:02X}>"] for b in part.encode()] if "<0x00>" in column else [len(names)]
            else:
                continue
            walk(at + k, p * table[own].prod(axis=0), used + own)

    walk(0, np.ones(table.shape[1]), [])
    return np.log(total), counts / total[0]


@pytest.mark.parametrize("spelled", [False, True])
@pytest.mark.parametrize("scaled", [False, True])
def test_forward_and_backward_sum_all_segmentations(monkeypatch, spelled, scaled):
    if scaled:  # as for long words, padded
        monkeypatch.setattr(langid, "LEAST_LOG", 0.0)
        monkeypatch.setattr(langid, "SHORT", 2)
    names = SMALL + (BYTES if spelled else [])
    pieces = langid.Pieces(names)
    table = langid._table(np.random.default_rng(1).random((len(names) + 1, 2)))
    words = ["a", "ab", "abab", "babx", "bbaab", "éab", "aaéb漢a"]
    want = [brute(names, table, "▁" + w) for w in words]
    assert np.allclose(langid.word_scores(pieces, table, words), [x for x, _ in want])
    times = np.arange(1, len(words) + 1)
    counts = langid.expected_counts(pieces, table, words, np.zeros(len(words), int), times)
    assert np.allclose(counts[:, 0], sum(n * c for n, (_, c) in zip(times, want))) and not counts[:, 1].any()


def test_the_whole_vocabulary_counts(names):
    assert {"translation", "▁information", "▁understand", "▁government", "<0x00>", "の", "▁The"} <= set(names) and len(names) > 31_000
    pieces = langid.Pieces(names)
    codes = np.array([[ord(c) for c in "▁information"]], dtype=np.uint64)
    assert pieces.spans(codes)[-1][0, 0] == names.index("▁information")


def test_words_of_any_length(names):
    pieces = langid.Pieces(names)
    table = langid._table(np.random.default_rng(2).random((len(names) + 1, 3)))
    words = ["anther" * 7, "漢字かな" * 300, "x" * 20_000, "ab"]
    scores = langid.word_scores(pieces, table, words)
    assert np.isfinite(scores).all() and scores[2].max() < -1000
    for word, score in zip(words[:2], scores):
        codes = np.array([[ord(c) for c in langid.BEGIN + word]], dtype=np.uint64)
        block, alpha = langid.Block(pieces, table, codes), [np.zeros(3)]
        for end in range(1, codes.shape[1] + 1):
            alpha.append(np.logaddexp.reduce([alpha[s] + np.log(block.table[i[0]]) for s, i in block.to(end) if i[0] != pieces.n + 1], axis=0))
        assert np.allclose(score, alpha[-1])
    counts = langid.expected_counts(pieces, table, words, np.zeros(4, int), np.ones(4))
    lengths = np.array([0 if n in BYTES else len(n) for n in names] + [0])
    spelled = counts[[names.index(b) for b in BYTES], 0].sum() / 3  # characters of three bytes
    assert np.isclose((counts[:, 0] * lengths).sum() + spelled, sum(len(w) + 1 for w in words))


def test_texts_without_spaces(make_docs, names):
    """Chinese and Japanese are learnt from runs of letters of any length, and told apart."""
    rng = random.Random(4)
    han = "的一是不了人我在有他这为之大来以个中上们到说国和地也子时道出而要于就下得可你年生自会那后能对着事其里所去行过家十用发天如然作方成者多日都三小军二无同么经法当起与好看学进种将还分此心前面又定见只主没公从"
    kana = "のはをにがでとたるしてれさいうえおかきくけこまみむめもやゆよらりろわんアイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホ人日本語大学中国時間今年"
    make = lambda chars: "。".join("".join(rng.choice(chars) for _ in range(rng.randint(30, 90))) for _ in range(6))
    texts = [make(han) if i % 2 else make(kana) for i in range(80)]
    docs = make_docs(texts).withColumn("lang", F.when(F.col("doc_id") % 2 == 1, "zh").otherwise("ja"))
    rows = langid.identify(docs, names).collect()
    assert all(r["lang_pred"] == ("zh" if r["doc_id"] % 2 else "ja") and r["score"] > 0.99 for r in rows)


def test_query_against_brute_force(make_docs, names):
    """Learning and prediction of whole texts by sums over all segmentations."""
    rng = random.Random(6)
    few = SMALL + BYTES
    texts = [" ".join("".join(rng.choice("aab" if i % 2 else "abbc") for _ in range(rng.randint(1, 6))) for _ in range(4)) for i in range(30)]
    texts += texts[:4]
    docs = make_docs(texts).withColumn("lang", F.when(F.col("doc_id") % 2 == 1, "x").otherwise("y"))
    rows = {r["doc_id"]: r for r in langid.identify(docs, few).collect()}
    table = langid._table(np.ones((len(few) + 1, 2)))
    for _ in range(langid.ROUNDS):
        counts = np.zeros((len(few) + 1, 2))
        for i, t in enumerate(texts):
            if zlib.crc32(str(i).encode()) % 3 != 1:
                for w in t.split():
                    counts[:, 1 - i % 2] += brute(few, table[:, [1 - i % 2]], "▁" + w)[1]
        table = langid._table(counts)
    for i, t in enumerate(texts):
        total = sum(brute(few, table, "▁" + w)[0] for w in t.split())
        assert rows[i]["lang_pred"] == "xy"[int(total.argmax())]
        assert np.isclose(rows[i]["score"], 1 / np.exp(total - total.max()).sum())


def test_language_cases(make_docs, nasty, names):
    rows = {r["doc_id"]: r for r in langid.identify(make_docs(nasty), names).collect()}
    assert len(rows) == len(nasty)
    for i, t in enumerate(nasty):
        assert (rows[i]["lang_pred"] == "und") == (not any(c.isalpha() for c in t or "")), t
    assert langid.identify(make_docs([]), names).count() == 0
    unlabelled = make_docs(["abc"], [1]).withColumn("lang", F.lit(None).cast("string"))
    (row,) = langid.identify(unlabelled, names).collect()
    assert (row["lang_pred"], row["score"]) == ("und", 0.0)
    docs = make_docs([*nasty, "some words here"] * 2, [None] * (2 * len(nasty) + 2))
    kept = langid.kept(docs, names)
    assert kept.columns == docs.columns and all(any(c.isalpha() for c in r["text"]) for r in kept.collect())


def test_order_of_rows_does_not_matter(make_docs, nasty, names):
    shuffled = list(enumerate(nasty))
    random.Random(1).shuffle(shuffled)
    a = langid.identify(make_docs(nasty), names).orderBy("doc_id").collect()
    b = langid.identify(make_docs([t for _, t in shuffled], [i for i, _ in shuffled]), names).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in a] == [r["lang_pred"] for r in b]


def test_rare_languages_are_learnt_and_untaught_ones_never_win(spark, names):
    """The cut is within each language: six German rows of three thousand all teach, and a language of digits is no language."""
    rng = random.Random(11)
    words = "the cat sat on a mat and then it went over river hills with some bread".split()
    rows = [(3 * i, " ".join(rng.choice(words) for _ in range(30)), "en") for i in range(3000)]
    rows += [(9000 + 3 * i, " ".join(rng.choice("der hund läuft über straße und schläft nicht gern".split()) for _ in range(30)), "de") for i in range(6)]
    rows += [(9100 + i, "12 34", "xx") for i in range(5)] + [(9200, "same words again", "fr")] * 800
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, names, rows=200)
    assert model.languages == ["de", "en", "fr"]
    texts = ["der hund über nicht", "same words again", "the cat and the river"]
    got = langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in got] == ["de", "fr", "en"]
    # What no text has is as likely in a language of few texts as in one of many.
    counts = np.zeros((50, 2))
    counts[:9, 0], counts[:7, 1] = 100_000, 3
    table = langid._table(counts)
    assert np.allclose(table[20:50, 0], table[20:50, 1]) and np.allclose(table.sum(axis=0), 1)
    assert langid.quota([5, 10, 1000], 45) == 30 and langid.quota([5, 6], 100) == 6 and langid.quota([7] * 10, 5) == 1
