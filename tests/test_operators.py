import json
import logging
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.functions.metrics import CATEGORIES
from scriptorium.operators import adapters, calibration, corpus, errors, images, logs, matrix, pairing, sampling

PAGE = "book_id string, page_id string"
CELL = "book_id string, page_id string, model string, preprocessing string"


def rows(df, *order):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_pairing(spark):
    images_ = spark.createDataFrame([("b", "p1", 1), ("b", "p2", 2)], PAGE + ", i int")
    texts = spark.createDataFrame([("b", "p1", 3), ("b", "p3", 4)], PAGE + ", t int")
    assert rows(pairing.pair(images_, texts)) == [("b", "p1", 1, 3, None), ("b", "p2", 2, None, "missing_text"), ("b", "p3", None, 4, "missing_image")]
    assert tuple(pairing.pairing_counts(images_, texts).first()) == (1, 1, 1)
    assert rows(pairing.set_comparison(images_.select("page_id"), texts.select("page_id"))) == [("p1", "both"), ("p2", "left"), ("p3", "right")]


def scoring(spark):
    truth = spark.createDataFrame([("book_a", "page_0001", "hello world"), ("book_a", "page_0002", "hello"), ("book_b", "page_0001", "test"), ("book_c", "page_0001", "   ")], PAGE + ", ref string")
    made = spark.createDataFrame([("book_a", "page_0001", "claude", "raw", "hello world"), ("book_a", "page_0002", "claude", "raw", "hellp"), ("book_b", "page_0001", "gemini", "raw", "test"), ("book_b", "page_0099", "gemini", "raw", "orphan"), ("book_c", "page_0001", "gemini", "preprocessed", "some text")], CELL + ", text string")
    return made, truth


def test_scores(spark):
    made, truth = scoring(spark)
    got = rows(matrix.score(made, truth))
    assert [(r[0], r[1], r[4]) for r in got] == [("book_a", "page_0001", 0.0), ("book_a", "page_0002", 0.2), ("book_b", "page_0001", 0.0)]
    assert {(r["page_id"], r["reason"]) for r in pairing.without_truth(made, truth).collect()} == {("page_0099", "missing_truth"), ("page_0001", "blank_truth")}


def test_summary(spark):
    scores = spark.createDataFrame([("b", str(i), "claude", "raw", c, c + 0.3) for i, c in enumerate((0.1, 0.2, 0.3))] + [("b", "1", "gemini", "raw", 0.5, 0.9)], CELL + ", cer double, wer double")
    got = {r["model"]: r for r in matrix.summarize(scores).collect()}
    assert got["claude"]["n"] == 3 and got["claude"]["mean_cer"] == pytest.approx(0.2) and got["claude"]["median_cer"] == 0.2 and got["claude"]["p90_cer"] == 0.3
    assert (got["gemini"]["n"], got["gemini"]["mean_cer"]) == (1, 0.5)


def test_one_to_one(spark):
    a = spark.createDataFrame([("b", "1", "m", "p", 1)], CELL + ", x int")
    b = spark.createDataFrame([("b", "1", "m", "p", 2)], CELL + ", y int")
    assert rows(pairing.one_to_one(a, b)) == [("b", "1", "m", "p", 1, 2)]
    for left, right, side in ((a.union(a), b, "left"), (a, b.union(b), "right")):
        with pytest.raises(Exception, match=f"{side}: duplicate key"):
            pairing.one_to_one(left, right).collect()


def test_costs(spark):
    cells = spark.createDataFrame([("claude", "raw", 0.281), ("claude", "opus_raw", 0.271), ("tesseract", "raw", 0.385), ("gemini", "raw", 0.564), ("gemini", "deskew_only", 0.3)], "model string, preprocessing string, mean_cer double")
    priced = pairing.with_cost(cells, matrix.cost_table(spark))
    got = {(r["model"], r["preprocessing"]): r for r in matrix.cost_per_point(priced, ("tesseract", "raw")).collect()}
    assert got["claude", "opus_raw"]["cost_per_point"] == pytest.approx(1.14, abs=0.01)
    assert got["claude", "raw"]["cost_per_point"] == pytest.approx(0.173, abs=0.001)
    assert got["gemini", "raw"]["cost_per_point"] is None and got["tesseract", "raw"]["cost_per_point"] is None
    assert not got["gemini", "deskew_only"]["cost_known"] and got["tesseract", "raw"]["cost_known"]


def test_cost_per_point_evaluates_its_cells_once(spark):
    """Means that differ between evaluations stand for sums in another order of rows."""
    again = F.udf(lambda: random.random(), "double").asNondeterministic()
    cells = spark.createDataFrame([("tesseract", "raw"), ("gemini", "raw"), ("claude", "raw")], "model string, preprocessing string").select("*", (again() + F.when(F.col("model") == "tesseract", 2).otherwise(0)).alias("mean_cer"), F.lit(1.0).alias("cost_per_page"))
    for _ in range(3):
        got = {r["model"]: r for r in matrix.cost_per_point(cells, ("tesseract", "raw")).collect()}
        assert len(got) == 3 and got["tesseract"]["cost_per_point"] is None
        for m in ("gemini", "claude"):
            assert got[m]["cost_per_point"] == pytest.approx(1 / (got["tesseract"]["mean_cer"] - got[m]["mean_cer"]))


def test_pending_pairs_and_collisions(spark):
    work = spark.createDataFrame([("b", str(i), "m", "p") for i in range(4)], CELL)
    assert sorted(r["page_id"] for r in pairing.pending(work, work.filter("page_id < '2'")).collect()) == ["2", "3"]
    cells = spark.createDataFrame([("b", "1", c, c) for c in "xyz"] + [("b", "2", "x", "x")], PAGE + ", cell string, text string")
    assert rows(pairing.unordered_pairs(cells, ("book_id", "page_id"), "cell", "text").select("text_a", "text_b")) == [("x", "y"), ("x", "z"), ("y", "z")]
    files = spark.createDataFrame([("o/p.png", "i/p.png"), ("o/p.png", "i/p.jpg"), ("o/q.png", "i/q.jpg")], "output_path string, input_path string")
    assert rows(pairing.output_collisions(files)) == [("o/p.png", "i/p.jpg", "kept"), ("o/p.png", "i/p.png", "collision"), ("o/q.png", "i/q.jpg", "kept")]
    names = spark.createDataFrame([("..a",), ("a",), (".b",), ("...",), ("c",)], "name string")
    assert rows(pairing.target_names(names)) == [("...", "", "empty"), ("..a", "a", "collision"), (".b", "b", "rename"), ("a", "a", "collision"), ("c", "c", "unchanged")]


def test_stratified(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(5000)] + [(9001, "c"), (9002, "c")], "id long, s string").repartition(5)
    one = sampling.stratified(df, "s", ["id"], 6, strict=False)
    assert {r["s"]: r["n"] for r in one.groupBy("s").agg(F.count("*").alias("n")).collect()} == {"a": 6, "b": 6, "c": 2}
    assert rows(one) == rows(sampling.stratified(df.repartition(2), "s", ["id"], 6, strict=False))
    assert rows(one) != rows(sampling.stratified(df, "s", ["id"], 6, seed=1, strict=False))
    with pytest.raises(Exception, match="fewer than 6 rows: c has 2"):
        sampling.stratified(df, "s", ["id"], 6).collect()
    assert sampling.stratified(df.filter("s <> 'c'"), "s", ["id"], 6).count() == 12


def test_stratified_with_few_distinct_keys(spark):
    df = spark.createDataFrame([(ord(s), s) for s in "abcdef" for _ in range(2000)], "id long, s string")
    for strict in (True, False):
        got = sampling.stratified(df, "s", ["id"], 6, strict=strict).groupBy("s").agg(F.count("*").alias("n")).collect()
        assert {r["s"]: r["n"] for r in got} == dict.fromkeys("abcdef", 6)


def test_stratified_exact(spark):
    data = [(i, "ab"[i % 2]) for i in range(40)]
    df = spark.createDataFrame(data, "id long, s string").coalesce(1)
    rng = random.Random(42)
    want = [k for s in "ab" for k in rng.sample([i for i, x in data if x == s], 6)]
    assert sorted(r["id"] for r in sampling.stratified_exact(df, "s", ["id"], 6).collect()) == sorted(want)
    with pytest.raises(ValueError, match="a has 20, b has 20"):
        sampling.stratified_exact(df, "s", ["id"], 21)


def test_stratified_exact_beyond_a_million_rows(spark):
    n = 1_200_000
    df = spark.range(0, n, 1, 7).select("id", F.when(F.col("id") % 3 == 0, "b").when(F.col("id") % 3 == 1, "a").alias("s"))
    strata = {None: range(2, n, 3), "a": range(1, n, 3), "b": range(0, n, 3)}
    rng = random.Random(7)
    want = [k for s in (None, "a", "b") for k in rng.sample(strata[s], 25)]
    assert sorted(r["id"] for r in sampling.stratified_exact(df, "s", ["id"], 25, seed=7).collect()) == sorted(want)


@pytest.mark.parametrize("how", ["inner", "full_outer"])
def test_heavy_keys_are_dealt(spark, how):
    """Half of the rows have one key; others are heavy on one side only, or light, or null."""
    left = [("x", 1)] * 300 + [("l", 2)] * 200 + [("a", 3), ("a", 4), ("b", 5), (None, 6)]
    right = [("x", 1)] * 70 + [("r", 2)] * 150 + [("a", 7), ("c", 8), (None, 9)]
    frame = lambda data, name: spark.createDataFrame([(k, i, v) for i, (k, v) in enumerate(data)], f"k string, {name}_id int, {name} int").repartition(3)
    a, b = frame(left, "l"), frame(right, "r")
    order = ["k", "l_id", "l", "r_id", "r"]
    want = rows(a.join(b, ["k"], how).select(*order))
    joined = pairing.spread_join(a, b, ("k",), how, most=40)
    assert rows(joined.select(*order)) == want
    heavy = pairing.heavy_keys(a, b, ("k",), 40)
    assert {r["k"]: (r["__left"], r["__right"]) for r in heavy.collect()} == {"x": (8, 2), "l": (5, 0), "r": (0, 4)}
    dealt = pairing._dealt(a, heavy.filter("k = 'x'"), ("k",), "__left", "__right")
    shares = [r["count"] for r in dealt.groupBy("__left_share", "__right_share").count().collect()]
    assert len(shares) == 16 and max(shares) < 0.3 * 300
    assert pairing.heavy_keys(a, b, ("k",), 1000) is None


def test_other_samples(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(100)], "id long, x double")
    assert sampling.spot_check(df, ["id"], 7).count() == 7 and sampling.spot_check(df, ["id"], 1000).count() == 100
    five = sampling.quantile_strata(df, "x", ["id"], 3)
    assert {r["stratum"]: r["n"] for r in five.groupBy("stratum").agg(F.count("*").alias("n")).collect()} == dict.fromkeys(range(1, 6), 3)
    tags = spark.createDataFrame([("p", "Faded"), ("p", "Damaged"), ("q", "Clean"), ("r", "new"), ("r", "Clean")], "page string, bucket string")
    assert rows(sampling.priority_bucket(tags, ["page"], "bucket", ("Damaged", "Faded", "Clean"))) == [("p", "Damaged"), ("q", "Clean"), ("r", "Clean")]


def test_ablation_and_order(spark):
    scores = spark.createDataFrame([("b", "1", "m", "raw", 0.5), ("b", "1", "m", "deskew_only", 3.0), ("b", "1", "m", "opus_raw", 0.1)], CELL + ", cer double")
    got = {r["preprocessing"]: r for r in matrix.ablation(scores).collect()}
    assert set(got) == set(matrix.VARIANT_ORDER) and got["preprocessed"]["mean_cer"] is None and got["preprocessed"]["n"] == 0
    assert (got["deskew_only"]["plotted"], got["deskew_only"]["clipped"]) == (1.0, True)
    ordered = matrix.reordered(spark.createDataFrame([("b", 1)], "v string, x int"), "v", ("a", "b")).orderBy("position").collect()
    assert [(r["v"], r["x"]) for r in ordered] == [("a", None), ("b", 1)]


#: Known counts of one cell, and what follows from them.
KNOWN = dict(zip(CATEGORIES, (2188, 979, 1803, 840, 409, 86, 38, 13)))


def test_shares_of_known_counts(spark):
    counts = spark.createDataFrame([("m", "raw", c, n) for c, n in KNOWN.items()] + [("m", "none", c, 0) for c in CATEGORIES], "model string, preprocessing string, category string, count long")
    assert rows(errors.totals(counts)) == [("m", "none", 0), ("m", "raw", 6356)]
    shares = {r["preprocessing"]: r for r in matrix.category_shares(counts, CATEGORIES).collect()}
    assert shares["raw"]["vowel_sign"] == pytest.approx(2188 / 6356) and sum(shares["raw"][c] for c in CATEGORIES) == pytest.approx(1)
    assert all(shares["none"][c] == 0 for c in CATEGORIES)
    top = {(r["preprocessing"], r["place"]): r["category"] for r in matrix.top_categories(counts, CATEGORIES).collect()}
    assert [top["raw", k] for k in (1, 2, 3)] == ["vowel_sign", "base_consonant_vowel", "conjunct"]
    assert [top["none", k] for k in (1, 2, 3)] == list(CATEGORIES[:3])


def test_error_categories(spark):
    made, truth = scoring(spark)
    extra = spark.createDataFrame([("book_a", "page_0002", "cell", "unknown", "x")], CELL + ", text string")
    got = {(r["model"], r["category"]): (r["count"], r["n_pages"]) for r in errors.by_cell(errors.page_units(made.union(extra), truth)).collect()}
    assert got["claude", "latin_punctuation"] == (1, 2) and got["gemini", "other"] == (0, 1) and len(got) == 2 * len(CATEGORIES)


def test_calibration(spark):
    made = spark.createDataFrame([("b", "1", c, "same text") for c in "xyz"] + [("b", "2", "x", "alone")], PAGE + ", cell string, text string")
    assert rows(calibration.page_agreement(made)) == [("b", "1", 1.0, 3)]
    scores = spark.createDataFrame([("b", str(i), m, "raw", float(i)) for i in range(6) for m in "pq"], CELL + ", cer double")
    ratings = scores.select("book_id", "page_id", "model", "preprocessing", F.when(F.col("model") == "p", 5 - F.col("cer")).otherwise(3).cast("int").alias("fluency_rating"))
    agreements = spark.createDataFrame([("b", str(i), 1 - i / 10) for i in range(6)], PAGE + ", agreement double")
    got = dict(rows(calibration.summary(scores, ratings, agreements)))
    assert got["spearman_p_raw"] == pytest.approx(-1) and got["spearman_q_raw"] is None and got["pearson_agreement_vs_mean_cer"] == pytest.approx(-1)


def test_corpus_numbers(spark):
    inv = spark.createDataFrame([("a", "1", 10, 5, 600, 100), ("a", "2", 20, 7, 600, 110), ("b", "1", 30, 9, 600, 130)], PAGE + ", image_bytes long, text_bytes long, image_width int, image_height int")
    assert tuple(corpus.totals(inv).first()) == (2, 3, 60, 21)
    row = corpus.stats_row(inv)
    assert row.first()["width"] == 600 and row.first()["dpi_estimate"] == 100.0
    assert json.loads(corpus.as_json(row).first()["value"])["mean_text_length_chars"] == 7.0
    mixed = corpus.stats_row(inv.withColumn("image_width", F.col("image_height"))).first()
    assert mixed["uniform_width"] is False and mixed["width"] is None
    manifest = spark.createDataFrame([("m", 10.0, False, None), ("m", None, True, None), ("m", None, None, "E: x")], "model string, latency_ms double, skipped boolean, error string")
    assert tuple(corpus.run_counters(manifest).first()) == (3, 1, 1, 1)
    assert tuple(corpus.latency(manifest).first()) == ("m", 10.0, 10.0, 1)
    ratings = spark.createDataFrame([(1,), (3,), (3,), (None,)], "fluency_rating int")
    assert rows(corpus.rating_distribution(ratings)) == [(1, 1, pytest.approx(100 / 3), pytest.approx(7 / 3)), (3, 2, pytest.approx(200 / 3), pytest.approx(7 / 3))]


def test_log_columns(spark):
    df = spark.createDataFrame([({"level": "x", "a": "1"},), ({"b": "2", "a": "1"},)], "m map<string,string>")
    got = df.select(logs.reserved_used(F.col("m")), logs.rendered(logs.extras_of(F.col("m")))).collect()
    assert [tuple(r) for r in got] == [(True, "a=1"), (False, "a=1 b=2")]


def logger_of(monkeypatch, **options):
    import io

    out = io.StringIO()
    monkeypatch.setattr("sys.stderr", out)
    return logs.configure(name="test.logs", **options), out


def test_log_lines(monkeypatch):
    logger, out = logger_of(monkeypatch)
    logger.info("hi %s", "é", extra={"page": "p1"})
    line = json.loads(out.getvalue())
    assert list(line) == ["ts", "level", "logger", "msg", "page"] and line["ts"].endswith("Z")
    assert (line["level"], line["logger"], line["msg"], line["page"]) == ("INFO", "test.logs", "hi é", "p1") and "é" in out.getvalue()
    logger, out = logger_of(monkeypatch, as_json=False)
    logger.warning("hi", extra={"b": 2, "a": 1})
    assert out.getvalue().endswith("WARNING  test.logs: hi a=1 b=2\n")


@pytest.mark.parametrize("as_json", [True, False])
def test_log_of_exceptions_and_reserved_keys(monkeypatch, as_json):
    logger, out = logger_of(monkeypatch, as_json=as_json)
    try:
        raise KeyError("lost")
    except KeyError:
        logger.exception("failed", extra={"page": "p2"})
    assert "Traceback" in out.getvalue() and "KeyError: 'lost'" in out.getvalue() and "p2" in out.getvalue()
    for key in ("ts", "level", "logger"):
        with pytest.raises(ValueError, match=key):
            logger.info("x", extra={key: 1})
    with pytest.raises(KeyError):  # the library's own check
        logger.info("x", extra={"msg": 1})
    assert len(out.getvalue().strip().splitlines()) >= 1 and set(logs.RESERVED) == {"ts", "level", "logger", "msg"}


def test_log_handlers_of_others_stay():
    other = logging.NullHandler()
    logging.getLogger("test.others").addHandler(other)
    for _ in range(3):
        logger = logs.configure(name="test.others")
    assert len(logger.handlers) == 2 and other in logger.handlers
    logger.removeHandler(other)


def bars(h=400, w=400):
    image = np.full((h, w, 3), 255, np.uint8)
    for y in range(40, h - 40, 40):
        image[y : y + 12, 60 : w - 60] = 0
    return image


def test_binarize():
    gradient = np.tile(np.arange(256, dtype=np.uint8), (200, 1))
    gradient[50:60, 20:200] = 0
    out = images.binarize(gradient)
    assert out.shape == gradient.shape and set(np.unique(out)) <= {0, 255}
    assert (images.binarize(np.full((5, 5), 128, np.uint8)) == 255).all() and (images.binarize(np.full((5, 5, 3), 127, np.uint8)) == 0).all()
    for bad in (1, 10, 0, -3):
        with pytest.raises(ValueError):
            images.binarize(gradient, bad)
    with pytest.raises(ValueError):
        images.binarize(np.zeros(4, np.uint8))


def test_deskew():
    straight = bars()
    assert images.deskew(straight) is straight and images.deskew(np.full((20, 20), 255, np.uint8)).shape == (20, 20)
    for angle in (5.0, -3.0, 25.0):
        tilted = images.rotate(straight, angle)
        fixed = images.deskew(tilted)
        assert fixed.shape == tilted.shape and abs(images.skew_angle(fixed)) < 0.5 < abs(images.skew_angle(tilted))
        assert (fixed[0, 0] == 255).all()
    with pytest.raises(ValueError):
        images.deskew(straight, -1)


def test_pipeline_of_stages(spark):
    pipe = images.default_pipeline()
    assert [n for n, _ in pipe.chosen()] == ["deskew", "binarize"]
    image = bars(80, 90)
    assert pipe.run(image, images.VARIANTS["raw"]) is image
    with pytest.raises(ValueError, match="unknown stages: blur"):
        pipe.run(image, {"blur": True})
    with pytest.raises(ValueError, match="unique"):
        images.Pipeline([("a", images.deskew, True), ("a", images.deskew, True)])
    df = spark.createDataFrame([("b", "1", 80, 90, 3, bytearray(image.tobytes())), ("b", "2", 80, 90, 3, bytearray(b"short"))], PAGE + ", height int, width int, channels int, pixels binary")
    good, bad = sorted(images.apply(df, pipe).collect(), key=lambda r: r["page_id"])
    assert (good["height"], good["width"], good["channels"], good["error"]) == (80, 90, 1, None)
    assert bytes(good["pixels"]) == pipe.run(image).tobytes() and bad["error"].startswith("ValueError")


def test_denoise():
    rng = np.random.default_rng(1)
    clean = np.clip(bars(60, 60), 60, 190)  # no noise is cut off
    noisy = np.clip(clean.astype(int) + rng.normal(0, 5, clean.shape), 0, 255).astype(np.uint8)
    for image, truth in ((noisy[..., 0], clean[..., 0]), (noisy, clean)):
        made = images.denoise(image)
        assert made.shape == image.shape and made.dtype == np.uint8
        assert np.abs(made.astype(int) - truth).mean() < 0.7 * np.abs(image.astype(int) - truth).mean()
    assert (images.denoise(np.full((9, 9), 77, np.uint8)) == 77).all() and images.denoise(np.zeros((1, 3), np.uint8)).shape == (1, 3)
    small = rng.integers(0, 30, (6, 5)).astype(np.uint8)
    wide = np.pad(small.astype(float), 8, mode="reflect")
    want = np.empty_like(small)
    for y in range(6):  # the definition, pixel by pixel
        for x in range(5):
            box = lambda v, u: np.pad(wide, 3, mode="reflect")[v : v + 7, u : u + 7]
            found = [(np.exp(-((images._box((small - wide[8 + dy : 14 + dy, 8 + dx : 13 + dx]) ** 2, 7)[y, x]) / 49 / 49)), wide[8 + y + dy, 8 + x + dx]) for dy in range(-4, 5) for dx in range(-4, 5)]
            found = [(w, v) for w, v in found if w >= 1e-3]
            want[y, x] = np.rint(sum(w * v for w, v in found) / sum(w for w, _ in found))
    assert (images.non_local_means(small[..., None])[..., 0] == want).all()


def test_contrast():
    ramp = np.tile(np.linspace(100, 140, 64).astype(np.uint8), (64, 1))
    made = images.contrast(ramp)
    assert made.shape == ramp.shape and np.ptp(made) > np.ptp(ramp)
    colour = np.stack([ramp, ramp, ramp], axis=-1)
    assert images.contrast(colour).shape == colour.shape and np.ptp(images.contrast(colour)) > np.ptp(ramp)
    assert images.contrast(np.full((5, 7), 9, np.uint8)).shape == (5, 7)
    flat = images.equalized(np.full((64, 64), 9, np.uint8))
    assert flat.min() == flat.max()
    rng = np.random.default_rng(2)
    pixels = rng.integers(0, 256, (500, 3)).astype(np.uint8)
    back = images.from_lab(images.to_lab(pixels)).astype(int)
    assert np.abs(back - pixels).mean() < 1  # bytes hold a and b of dark colours coarsely
    assert images.to_lab(np.array([[255, 255, 255], [0, 0, 255]], np.uint8)).tolist() == [[255, 128, 128], [136, 208, 195]]
    for variant, enable in images.VARIANTS.items():
        assert images.default_pipeline().run(bars(90, 80), enable).shape[:2] == (90, 80), variant


def test_service_contracts():
    """Attempts, which failures are tried again, and blocked answers of each registered service."""

    def outcomes(name, *answers):
        left = list(answers)

        def client(request):
            answer = left.pop(0)
            if isinstance(answer, Exception):
                raise answer
            return answer

        chosen = adapters.adapter(name, make_client=lambda: client)
        call = chosen.make_client()
        try:
            return adapters.with_retries(lambda: call({}), chosen.attempts, sleep=lambda s: None), len(answers) - len(left)
        except Exception as e:
            return type(e), len(answers) - len(left)

    error = adapters.ServiceError
    assert outcomes("gemini", error(429), error(503), "text") == ("text", 3)
    assert outcomes("gemini", *[error(429)] * 9) == (adapters.TransientError, 7)
    assert outcomes("gemini", error(500), "text") == (error, 1) and outcomes("gemini", error(None), "text") == (error, 1)
    assert outcomes("gemini", adapters.Blocked()) == ("", 1)
    assert outcomes("claude", error(429), error(529), error(500), error(None), "text") == ("text", 5)
    assert outcomes("claude", *[error(500)] * 9) == (adapters.TransientError, 5)
    assert outcomes("claude", error(400), "text") == (error, 1) and outcomes("claude", error(404), "text") == (error, 1)
    assert adapters.adapter("tesseract").cleans is False
    with pytest.raises(ValueError, match="tesseract"):
        adapters.adapter("other")


def test_retries():
    waited, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise adapters.TransientError("busy")
        return "ok"

    assert adapters.with_retries(flaky, 5, waited.append, random.Random(1)) == "ok"
    assert len(waited) == 2 and 2 <= waited[0] <= 3 and 4 <= waited[1] <= 5
    with pytest.raises(adapters.TransientError):
        adapters.with_retries(lambda: (_ for _ in ()).throw(adapters.TransientError("x")), 2, waited.append)
    with pytest.raises(KeyError):
        adapters.with_retries(lambda: {}["x"], 5, waited.append)
    assert [adapters.retryable_status(s) for s in (400, 429, 500, 503)] == [False, True, True, True]


def test_transcribe(spark):
    import base64

    def make():
        def run(request):
            page = base64.b64decode(request["image"]).decode()
            if page == "bad":
                raise RuntimeError("no")
            return {"refused": "I cannot read it", "blank": " \n"}.get(page, "క" + page)

        return run

    df = spark.createDataFrame([("b", p, bytearray(p.encode())) for p in ("one", "bad", "refused", "blank")], PAGE + ", content binary")
    got = {r["page_id"]: r for r in adapters.transcribe(df, adapters.Adapter("fake", make), tasks=2).collect()}
    assert (got["one"]["text"], got["one"]["text_length"], got["one"]["error"]) == ("కone", 4, None)
    assert got["bad"]["error"] == "RuntimeError: no" and got["bad"]["latency_ms"] is None and got["bad"]["text"] is None
    assert got["refused"]["text"] == got["blank"]["text"] == ""
    assert adapters.adapter("fake").make_client()({"a": 1}) == adapters.fake_client()({"a": 1})
    with pytest.raises(ValueError, match="unknown adapter"):
        adapters.adapter("nope")
    cat = adapters.adapter("command", command=["cat"])
    (row,) = adapters.transcribe(df.filter("page_id = 'blank'"), cat).collect()
    assert row["text"] == "blank"
    (row,) = adapters.transcribe(df.filter("page_id = 'one'"), adapters.adapter("command", command=["false"])).collect()
    assert row["error"].startswith("RuntimeError: exit 1")


def test_judge_runs(spark):
    def make():
        return lambda request: '{"rating": 4}' if "good" in request["prompt"] else "nonsense"

    df = spark.createDataFrame([("b", "1", "m", "raw", "good text"), ("b", "2", "m", "raw", "  "), ("b", "3", "m", "raw", "other")], CELL + ", text string")
    rated, failed = adapters.judge(df, adapters.Adapter("j", make), "Rate: {text}")
    assert sorted((r["page_id"], r["fluency_rating"]) for r in rated.collect()) == [("1", 4), ("2", 1)]
    assert [(r["page_id"], r["error"]) for r in failed.collect()] == [("3", "not valid JSON")]
