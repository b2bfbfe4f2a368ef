import random
import tracemalloc
import unicodedata
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.functions import distance, judge, metrics, order, stats, text


def values(spark, rows, ddl, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, ddl).select(*columns).collect()]


def table_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


CER = [("hello", "hello", 0.0), ("hello", "xyzqr", 1.0), ("hello", "hellp", 0.2), ("hello", "hell", 0.2), ("hello", "hellos", 0.2), ("hello", "", 1.0), (" ", " ", 0.0), ("é", "é", 0.0), ("ab", "abcdefgh", 3.0)]


def test_cer(spark):
    got = values(spark, [(a, b) for a, b, _ in CER], "a string, b string", metrics.cer(F.col("a"), F.col("b")))
    assert [g[0] for g in got] == [c for *_, c in CER]


def test_cer_of_empty_reference_fails(spark):
    with pytest.raises(Exception, match="reference must not be empty"):
        values(spark, [("", "x")], "a string, b string", metrics.cer(F.col("a"), F.col("b")))


def test_wer(spark):
    quick = "the quick brown fox"
    cases = [(quick, quick, 0.0), (quick, "the quick brown dog", 0.25), (quick, "the quick brown", 0.25), (quick, "alpha beta gamma delta", 1.0), (quick, "", 1.0), ("a  b\nc", "a b c", 0.0)]
    got = values(spark, [(a, b) for a, b, _ in cases], "a string, b string", metrics.wer(F.col("a"), F.col("b")))
    assert [g[0] for g in got] == [c for *_, c in cases]
    (single,) = values(spark, [("a b\nc", "a b c")], "a string, b string", metrics.wer(F.col("a"), F.col("b"), "single_space"))
    assert single[0] == 1.0  # the line feed stays in its token
    with pytest.raises(Exception, match="no words"):
        values(spark, [(" \n", "x")], "a string, b string", metrics.wer(F.col("a"), F.col("b")))


def test_word_distance_of_many_words(spark):
    rng = random.Random(1)
    pairs = [([f"w{rng.randrange(900)}" for _ in range(600)], [f"w{rng.randrange(900)}" for _ in range(500)]), (list("abc"), list("abd"))]
    rows = [(" ".join(a), " ".join(b)) for a, b in pairs]
    got = values(spark, rows, "a string, b string", distance.sequence_distance(F.split("a", " "), F.split("b", " ")))
    assert [g[0] for g in got] == [table_distance(a, b) for a, b in pairs]


def test_distances_of_close_and_far_texts(spark):
    rng = random.Random(2)
    rows = []
    for n in (5, 40, 300, 1500):
        a = "".join(rng.choice("abcd") for _ in range(n))
        for edits in (0, 3, 20, 200):
            b = list(a)
            for _ in range(edits):
                b[rng.randrange(len(b))] = rng.choice("abcdé🎉")
            rows.append((a, "".join(b)))
    got = values(spark, rows, "a string, b string", distance.text_distance(F.col("a"), F.col("b")), F.levenshtein("a", "b"))
    assert all(x == y for x, y in got)


def as_numbers(texts):
    return np.array([ord(c) for t in texts for c in t], np.int64), np.array([len(t) for t in texts], np.int64)


TEXT = st.text("abcé🎉", max_size=90)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), max_size=30), st.sampled_from([0, 10**9]))
def test_every_way_to_a_distance(pairs, worth):
    """Together and one by one; along diagonals up to a limit, and column by column."""
    want = [table_distance(a, b) for a, b in pairs]
    distance.WORTH, before = worth, distance.WORTH
    try:
        assert distance.distances(*as_numbers([a for a, _ in pairs]), *as_numbers([b for _, b in pairs])).tolist() == want
    finally:
        distance.WORTH = before
    for (a, b), d in zip(pairs, want):
        x, y = (as_numbers([t])[0] for t in (a, b))
        assert distance.by_column(a, b) == d == distance.one_distance(*distance.trimmed(x, y))
        for limit in (0, 3, 100):
            assert distance.along_diagonals(x, y, limit) == (d if d <= limit else None)


def test_texts_that_only_lack_characters(monkeypatch):
    """What lies within the longer side in order needs no table, however long; what does not gets its table."""
    rng = random.Random(4)
    long = ["".join(rng.choice("etaoinsh é漢") for _ in range(n)) for n in (1, 70, 900, 200_000)]
    short = [t.replace("th", "t").replace("é", "") for t in long]
    gaps = [len(a) - len(b) for a, b in zip(long, short)]
    for name in ("group_distances", "one_distance"):
        monkeypatch.setattr(distance, name, lambda *_: pytest.fail("a table was made"))
    assert distance.distances(*as_numbers(long), *as_numbers(short)).tolist() == gaps == distance.distances(*as_numbers(short), *as_numbers(long)).tolist()
    monkeypatch.undo()
    odd = [t[: len(t) // 2] + "#" + t[len(t) // 2 + 1 :] for t in short[1:3]]
    assert distance.distances(*as_numbers(long[1:3]), *as_numbers(odd)).tolist() == [table_distance(a, b) for a, b in zip(long[1:3], odd)]


def test_memory_goes_with_no_batch():
    """Batches of 40 million characters, and of fewer; nulls and an overlong text among them. What Python and NumPy hold stays below 200 MB."""
    rng = random.Random(5)
    text = "".join(rng.choice("abcdef ") for _ in range(2000))
    far = ["".join(rng.choice("abcdef ") for _ in range(300)) for _ in range(200)]
    a = pa.array([*far[:100], None, *([text] * 10_000), text * 3000, ""])
    b = pa.array([*far[100:], text, *([text[:900] + "#" + text[901:]] * 10_000), text * 2999 + "#" + text[1:], None])
    want = [table_distance(x, y) for x, y in zip(far[:5], far[100:105])]
    peaks = []
    for stop in (3000, len(a)):
        tracemalloc.start()
        got = distance.text_distance.func(a.slice(0, stop), b.slice(0, stop)).to_pylist()
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert got[:5] == want and got[100] is None and set(got[101:3000]) == {1}
    assert got[-3:] == [1, 1, None] and peaks[1] < 200 << 20, peaks


def test_nfc_of_parts(monkeypatch):
    texts = ["e\u0301" * n for n in range(1, 40)] + [None, "", "plain", "\u0c46\u0c56"]
    want = [t and unicodedata.normalize("NFC", t) for t in texts]
    for items in (1, 50, text.ITEMS):
        monkeypatch.setattr(text, "ITEMS", items)
        for some in (pa.array(texts), pa.array(["x", *texts, "y"]).slice(1, len(texts))):
            assert text.nfc.func(some).to_pylist() == want
    assert list(text.parts(np.array([3, 3, 9, 0, 1, 1]), 6)) == [(0, 2), (2, 3), (3, 6)] and not list(text.parts(np.array([], int), 6))


def test_two_million_distinct_words(spark):
    """Two arrays of a million words, all of them distinct but for what they share; edits lie at both ends and between."""
    n = 1_000_000
    made = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(2 * n - 1)), lambda i: F.concat(F.lit("w"), i)).alias("a"))
    changed = F.transform("a", lambda w, i: F.when(i % 50_000 == 3, F.concat(w, F.lit("x"))).otherwise(w))
    assert made.select(distance.sequence_distance("a", F.concat(F.array(F.lit("new")), changed)).alias("d")).first()["d"] == 41
    assert made.select(distance.sequence_distance(F.slice("a", 1, n), F.slice("a", n + 1, 2000)).alias("d")).first()["d"] == n


def test_words_may_be_null(spark):
    got = values(spark, [(["a", None, "b"], ["a", "b"]), ([], ["x"]), (None, ["x"]), (["x"], [])], "a array<string>, b array<string>", distance.sequence_distance("a", "b"))
    assert got == [(1,), (1,), (None,), (1,)]


def test_agreement(spark):
    long_a, long_b = "the cat sat on the mat " * 12, "the bat sat on the mat " * 12
    rows = [("hello", "hello"), ("abc", "xyz"), ("", ""), ("", "hello"), ("x" * 199, "x" * 199 + "y"), (long_a, long_b), (long_b, long_a[:199]), (None, "a")]
    got = [g[0] for g in values(spark, rows, "a string, b string", metrics.agreement("a", "b"))]
    assert got[:4] == [1.0, 0.0, 1.0, 0.0] and got[-1] is None
    assert got[4:7] == [SequenceMatcher(None, a, b).ratio() for a, b in rows[4:7]]


def test_edit_classes_agree(spark):
    rows = ["", " \n", "క", "క్", "ా", "కా", "a", "é", "!", "7", "漢", "a ", "ాa", "　", "—", "్", "€", "😀"]
    got = [g[0] for g in values(spark, [(r,) for r in rows], "t string", text.edit_class(F.col("t")))]
    assert got == [metrics.classify(r) for r in rows]
    assert got[:8] == ["other", "whitespace", "base_consonant_vowel", "conjunct", "vowel_sign", "vowel_sign", "latin_punctuation", "latin_punctuation"]
    classes = [g[0] for g in values(spark, [(c,) for c in "్ాకa! 漢"], "t string", text.code_point_class(F.col("t")))]
    assert classes == ["virama", "vowel_sign", "base", "latin_or_punctuation", "latin_or_punctuation", "space", "other"]


def test_edit_units():
    assert metrics.edit_units("abc", "abc") == {} and metrics.edit_units("", "abc") == {}
    assert metrics.edit_units("ab", "ab" + "x" * 7) == {"latin_punctuation": 7}
    assert metrics.edit_units("ab", "ab" + "x" * 8) == {"hallucination_burst": 1}
    assert metrics.edit_units("ab" + "漢" * 8, "ab") == {"omission_burst": 1}
    assert metrics.edit_units("漢" * 9 + "ab", "字" * 9 + "ab") == {"omission_burst": 1, "hallucination_burst": 1}
    assert metrics.edit_units("漢" * 9 + "ab", "字ab") == {"omission_burst": 1}
    assert metrics.edit_units("a b", "a  b") == {"whitespace": 1}


def test_edit_units_udf(spark):
    got = values(spark, [("abc", "abd"), (None, "x"), ("", "x")], "a string, b string", metrics.edit_categories()("a", "b"))
    assert [g[0] for g in got] == [{"latin_punctuation": 1}, None, {}]


def test_normal_form(spark):
    rows = [("é",), ("é",), ("plain",), (None,)]
    got = values(spark, rows, "t string", text.nfc(F.col("t")), text.is_nfc(F.col("t")))
    assert got == [("é", False), ("é", True), ("plain", True), (None, None)]
    assert all(g[0] is None or unicodedata.is_normalized("NFC", g[0]) for g in got)


def test_cell_names(spark):
    got = values(spark, [("claude_opus_raw",), ("gemini_raw",), ("tesseract",)], "c string", text.model_of_cell(F.col("c")), text.preprocessing_of_cell(F.col("c")))
    assert got == [("claude", "opus_raw"), ("gemini", "raw"), ("tesseract", "unknown")]


def test_refusals(spark):
    rows = ["Sorry, I can't read this.", "x" * 29, "x" * 30, "  " + "x" * 29 + "\n", "", "  \n", "1924", "క short", "long " * 20]
    got = values(spark, [(r,) for r in rows], "t string", text.is_refusal(F.col("t")), text.model_output(F.col("t")))
    assert [g[0] for g in got] == [True, True, False, True, False, False, True, False, False]
    assert [g[1] for g in got] == ["", "", rows[2], "", "", "", "", rows[7], rows[8]]


def test_paths_and_sizes(spark):
    rows = [("/a/b/x.tar.gz", 500), ("/a/y.JPG", 2047), ("/other/z", 3 * 2**20 + 5), ("/a/.hidden", 5 * 2**40)]
    got = values(spark, rows, "p string, n long", text.relative_to(F.col("p"), "/a"), text.stem(F.col("p")), text.with_suffix(F.col("p"), ".png"), text.format_bytes(F.col("n")))
    assert got == [("b/x.tar.gz", "x.tar", "/a/b/x.tar.png", "500.0 B"), ("y.JPG", "y", "/a/y.png", "1.0 KB"), ("/other/z", "z", "/other/z.png", "3.0 MB"), (".hidden", ".hidden", "/a/.hidden.png", "5.0 TB")]
    assert values(spark, [("x.JPEG",), ("x.png",)], "p string", text.media_type(F.col("p"))) == [("image/jpeg",), ("image/png",)]
    with pytest.raises(Exception, match="unsupported image extension"):
        values(spark, [("x.gif",)], "p string", text.media_type(F.col("p")))


def test_utf8_prompt_and_blocks(spark):
    got = values(spark, [(b"ok \xc3\xa9",), (b"\xff",)], "b binary", text.valid_utf8(F.col("b")))
    assert got == [("ok é",), (None,)]
    assert values(spark, [("T",)], "t string", text.prompt('{{"a": "{t}"}} {t}', t=F.col("t"))) == [('{"a": "T"} T',)]
    blocks = [([("text", "a"), ("image", "x"), ("text", "b")],)]
    assert values(spark, blocks, "b array<struct<type:string,text:string>>", text.joined_blocks(F.col("b"))) == [("ab",)]
    assert values(spark, [(b"x" * 100,)], "b binary", F.instr(text.base64_line(F.col("b")), "\n")) == [(0,)]


JUDGED = [
    ('{"rating": 4, "reason": "ok", "error_examples": ["a", 7]}', (4, "ok", ["a", "7"], None)),
    ('```json\n{"rating": 2, "reason": "x"}\n```', (2, "x", [], None)),
    ('{"rating": 5}', (5, "", [], None)),
    ('{"reason": "x"}', (None, None, None, "missing rating")),
    *((f'{{"rating": {v}}}', (None, None, None, "rating must be an integer 1-5")) for v in ("0", "6", "3.0", '"3"', "true", "null", "[1]")),
    ("I would say 4", (None, None, None, "not valid JSON")),
    ("[4]", (None, None, None, "not an object")),
    ('{"rating": 3, "reason": 5}', (None, None, None, "reason must be a string")),
    ('{"rating": 3, "error_examples": "x"}', (None, None, None, "error_examples must be a list")),
    (None, (None, None, None, "not valid JSON")),
]


def test_judge(spark):
    got = values(spark, [(a,) for a, _ in JUDGED], "a string", judge.parse(F.col("a")))
    assert [tuple(g[0]) for g in got] == [w for _, w in JUDGED]


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_order_statistics(spark, ranges):
    """Groups that lie in one range and groups spread over many, with ties, nulls, a null key, and groups without a value."""
    rng = random.Random(9)
    groups = {"one": [1.0], "even": [1.0, 2.0, 3.0, 4.0], "ties": [5.0, 5.0, 1.0], None: [rng.random() for _ in range(700)], "big": [float(rng.randrange(90)) for _ in range(900)], "none": []}
    rows = [(g, x) for g, xs in groups.items() for x in [*xs, None]]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, x double")
    places = {"middle": stats.upper_middle, "p90": stats.nine_tenths}
    wanted = {"low": 0.1, "mid": 0.5, "top": 1.0}
    for frame, n in ((df, None), (df.groupBy("g", "x").agg(F.count("*").alias("n")), "n")):
        got = {r["g"]: (r["middle"], r["p90"]) for r in order.placed(frame, ["g"], "x", n, places, ranges).collect()}
        assert got == {g: (sorted(xs)[len(xs) // 2], sorted(xs)[min(int(len(xs) * 0.9), len(xs) - 1)]) if xs else (None, None) for g, xs in groups.items()}
        for r in order.quantiles(frame, ["g"], "x", wanted, n, ranges).collect():
            xs = groups[r["g"]]
            assert [r[k] for k in wanted] == (pytest.approx(list(np.quantile(xs, list(wanted.values())))) if xs else [None] * 3)
    (all_in_one,) = order.quantiles(df, [], "x", {"q": 0.37}, None, ranges).collect()
    assert all_in_one["q"] == pytest.approx(np.quantile([x for xs in groups.values() for x in xs], 0.37))
    ranks = {(r["g"], r["x"]): r["r"] for r in order.average_ranks(df, ["g"], "x", "r", ranges).collect()}
    assert ranks == {(g, x): sum(y < x for y in xs) + (sum(y == x for y in xs) + 1) / 2 for g, xs in groups.items() for x in xs}
    assert order.quantiles(df.filter("false"), [], "x", wanted).count() == 0 and order.placed(df.filter("false"), ["g"], "x", None, places).count() == 0


def test_a_huge_group_is_spread_over_tasks(spark):
    """One cell of ten million distinct values: no range holds more than a few per cent of it, and neither does any file that a task reads."""
    n, ranges = 10_000_000, 64
    df = spark.range(n).select(F.lit("cell").alias("g"), (F.col("id") * 7919 % n).cast("double").alias("x"))
    table = order.counted(df, ["g"], "x", None, ranges)
    sizes = [r["rows"] for r in order.ranges_of(table).select(F.col(order.ROWS).alias("rows")).collect()]
    assert len(sizes) > 50 and sum(sizes) == n and max(sizes) < 0.05 * n
    row = order.interpolated(table, [0.25, 0.5]).first()
    assert (row["q0"], row["q1"]) == ((n - 1) / 4, (n - 1) / 2)


def test_correlations(spark):
    import pandas as pd

    rng = random.Random(3)
    rows = [(rng.choice("ab"), float(rng.randrange(5)), float(rng.randrange(4)), 1.0) for _ in range(200)] + [("c", 1.0, 2.0, 1.0), ("a", None, 1.0, 1.0)]
    df, frame = spark.createDataFrame(rows, "g string, x double, y double, flat double"), pd.DataFrame(rows, columns=["g", "x", "y", "flat"]).dropna()
    ranked = frame.assign(x=frame["x"].rank(), y=frame["y"].rank())
    assert stats.spearman(df, "x", "y").first()["rho"] == pytest.approx(ranked["x"].corr(ranked["y"]))
    for r in stats.spearman(df, "x", "y", ["g"], 5).collect():
        own = frame[frame["g"] == r["g"]]
        assert r["n"] == len(own) and r["rho"] == pytest.approx(own["x"].rank().corr(own["y"].rank()))
    assert {r["g"] for r in stats.spearman(df, "x", "y", ["g"], 5).collect()} == {"a", "b"}
    assert df.agg(stats.pearson(F.col("x"), F.col("flat"))).first()[0] is None
    assert df.filter("g = 'c'").agg(stats.pearson(F.col("x"), F.col("y"))).first()[0] is None
    got = {r["x"]: r["r"] for r in stats.average_ranks(df.filter("x is not null"), "x", "r").select("x", "r").distinct().collect()}
    assert got == dict(zip(frame["x"], frame["x"].rank()))


def test_distribution_summaries(spark):
    xs = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 100.0]
    df = spark.createDataFrame([("g", x) for x in xs] + [("g", None)], "g string, x double")
    assert tuple(order.five_numbers(df, ["g"], "x").first()) == ("g", 9, 3.0, 5.0, 7.0, 1.0, 8.0, 1)
    bins = {r["bin"]: r["n"] for r in stats.histogram(df, "x", 4).collect()}
    assert bins == {0: 8, 1: 0, 2: 0, 3: 1}
    flat = stats.histogram(spark.createDataFrame([(2.0,), (2.0,)], "x double"), "x", 3)
    assert {r["bin"]: r["n"] for r in flat.collect()} == {0: 2, 1: 0, 2: 0}
    assert stats.histogram(df.filter("false"), "x").count() == 0
    row = stats.describe(df, ["x"]).first()
    assert (row["count"], row["min"], row["p50"], row["max"]) == (9, 1.0, 5.0, 100.0)
    pairs = spark.createDataFrame([(1.0, 0.0), (0.0, 2.0), (3.0, 0.0), (4.0, 4.0), (0.0, 3.0)], "x double, y double")
    assert tuple(stats.wilcoxon(pairs, "x", "y").first()) == (4, 1 + 3.5, 2 + 3.5)
