import json
import os
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from scriptorium import schemas
from scriptorium.sources import commits, corpus, headers, sinks
from scriptorium.streaming import incremental


def png(w, h):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IEND", b"")


def jpeg(w, h):
    return b"\xff\xd8\xff\xe0\x00\x04ab" + b"\xff\xff\xc0" + struct.pack(">HBHHB", 11, 8, h, w, 1) + b"\x01\x11\x00" + b"\xff\xd9"


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "corpus"
    files = {"book_alpha/p1.jpg": jpeg(10, 20), "book_alpha/p1.txt": b"one", "book_alpha/p2.png": png(30, 40), "book_alpha/p2.txt": "é".encode(), "book_beta/p1.jpg": jpeg(5, 6), "book_beta/p1.txt": b"\xff", "book_beta/p2.jpg": jpeg(5, 6), "book_beta/p3.txt": b"x", "book_beta/p4.jpg": b"broken", "book_beta/p4.txt": b"y", ".hidden/p1.jpg": jpeg(1, 1), "root.jpg": jpeg(1, 1), "book_beta/deep/p9.JPG": jpeg(1, 1)}
    for name, body in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body)
    return str(root)


def test_image_sizes():
    assert headers.image_size(png(7, 9)) == (7, 9) and headers.image_size(jpeg(7, 9)) == (7, 9)
    assert headers.image_size(b"GIF89a") is None and headers.image_size(None) is None and headers.image_size(b"\xff\xd8\xff\xe0\x00\x04ab") is None


def test_inventory(spark, tree):
    found, bad = corpus.inventory(spark, tree)
    assert sorted((r["book_id"], r["page_id"], r["image_width"], r["image_height"]) for r in found.collect()) == [("book_alpha", "p1", 10, 20), ("book_alpha", "p2", 30, 40), ("book_beta", "p1", 5, 6)]
    assert found.schema.names == schemas.PAGE_INVENTORY.names and bad.schema.names == schemas.MISMATCH.names
    assert sorted((r["page_id"], r["reason"].split(":")[0]) for r in bad.collect()) == [("p2", "missing_text"), ("p3", "missing_image"), ("p4", "image_unreadable"), ("p9", "missing_text")]
    with pytest.raises(Exception):
        corpus.inventory(spark, tree + "/nowhere")[0].collect()


def test_inventory_of_late_headers(spark, tmp_path):
    (tmp_path / "book").mkdir()
    plain = jpeg(7, 9)
    (tmp_path / "book" / "p1.jpg").write_bytes(plain[:2] + (b"\xff\xe2\xff\xff" + b"x" * 65533) * 3 + plain[2:])
    (tmp_path / "book" / "p2.jpg").write_bytes(plain)
    (tmp_path / "book" / "p3.jpg").write_bytes(b"\xff\xd8" + b"x" * 100_000)
    for page in ("p1", "p2", "p3"):
        (tmp_path / "book" / f"{page}.txt").write_text("t")
    found, bad = corpus.inventory(spark, str(tmp_path))
    assert sorted((r["page_id"], r["image_width"], r["image_height"]) for r in found.collect()) == [("p1", 7, 9), ("p2", 7, 9)]
    assert [r["page_id"] for r in bad.collect()] == ["p3"]


def test_headers_are_read_in_ranges(spark, tmp_path):
    """Large images cost a few kilobytes each, and a size behind long segments is still found."""
    body = b"\x00" * 3_000_000
    late = jpeg(7, 9)
    late = late[:2] + (b"\xff\xe2\xff\xff" + b"x" * 65533) * 30 + late[2:]
    for book in ("a", "b", ".c"):
        (tmp_path / book / "deep").mkdir(parents=True)
        (tmp_path / book / "p1.jpg").write_bytes(jpeg(11, 12) + body)
        (tmp_path / book / "deep" / "p2.PNG").write_bytes(png(3, 4) + body)
        (tmp_path / book / "p3.jpeg").write_bytes(late + body)
        (tmp_path / book / "p4.txt").write_bytes(b"t" * 10)
        (tmp_path / book / ".p5.jpg").write_bytes(late)
    (tmp_path / "p6.jpg").write_bytes(late)
    got = {r["relative"]: r for r in headers.scan(spark, str(tmp_path), tasks=2).collect()}
    assert set(got) == {f"{b}/{n}" for b in "ab" for n in ("p1.jpg", "deep/p2.PNG", "p3.jpeg", "p4.txt")}
    assert [(got[f"a/{n}"]["width"], got[f"a/{n}"]["height"], got[f"a/{n}"]["page_id"]) for n in ("p1.jpg", "deep/p2.PNG", "p3.jpeg", "p4.txt")] == [(11, 12, "p1"), (3, 4, "p2"), (7, 9, "p3"), (None, None, "p4")]
    assert sum(r["bytes_read"] for r in got.values()) < 0.03 * sum(r["length"] for r in got.values())
    assert got["b/p4.txt"]["length"] == 10 and got["b/p4.txt"]["bytes_read"] == 0
    with pytest.raises(Exception):
        headers.scan(spark, str(tmp_path / "no")).collect()


class DiesOnce(commits.Writer):
    """Kills its Python worker between write and commit, the first time."""

    def write(self, iterator):
        made = super().write(iterator)
        mark = os.path.join(self.path, "died")
        if made.files and not os.path.exists(mark):
            open(mark, "w").close()
            os._exit(1)
        return made


def test_a_broken_run_leaves_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    commits.append(scores(spark, 3), path)
    monkeypatch.setattr(commits, "Writer", DiesOnce)
    with pytest.raises(Exception):
        commits.append_new(scores(spark, 9).repartition(3), path)
    assert commits.committed(path)[0] == 1 and sorted(r["page_id"] for r in commits.read(spark, path, schemas.SCORE).collect()) == ["0", "1", "2"]
    commits.append_new(scores(spark, 9).repartition(3), path)  # the same run again
    commits.append_new(scores(spark, 9).union(scores(spark, 9)), path)  # and once more
    assert sorted(r["page_id"] for r in commits.read(spark, path, schemas.SCORE).collect()) == [str(i) for i in range(9)]
    assert commits.read(spark, str(tmp_path / "none"), schemas.SCORE).count() == 0


def test_writers_that_meet(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    commits.append(scores(spark, 2), path)
    number = commits.committed(path)[0]
    commits.append(scores(spark, 4).filter("page_id > '1'"), path, number)
    files = set(os.listdir(path))
    with pytest.raises(Exception, match="taken by another writer"):
        commits.append(scores(spark, 6), path, number)
    assert set(os.listdir(path)) == files  # the loser's files are gone
    real, calls = commits.committed, []

    def late(p):
        """The first look is from before another writer's commit."""
        calls.append(p)
        return (number, real(p)[1][:1]) if len(calls) < 3 else real(p)

    monkeypatch.setattr(commits, "committed", late)
    commits.append_new(scores(spark, 6), path)
    assert sorted(r["page_id"] for r in commits.read(spark, path, schemas.SCORE).collect()) == list("012345")


def test_resuming_does_not_shuffle_the_sink(spark):
    spark.sql("DROP TABLE IF EXISTS done_scores")
    sinks.bucketed(scores(spark, 30), "done_scores", buckets=8)
    sinks.bucketed(scores(spark, 40).filter("cast(page_id as int) >= 30"), "done_scores", buckets=8)
    left = sinks.pending_of(scores(spark, 50).drop("wer"), "done_scores")
    assert sorted(int(r["page_id"]) for r in left.collect()) == list(range(40, 50))
    plan = left._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[0]
    assert "SortMergeJoin" in final and final.count("Exchange hashpartitioning") == 1
    spark.sql("DROP TABLE done_scores")


def test_books_and_encoding(spark, tree):
    books = {r["book_id"]: r["paths"] for r in corpus.discover_books(spark, tree).collect()}
    assert books["."] == ["root.jpg"] and books["book_beta"] == ["book_beta/deep/p9.JPG", "book_beta/p1.jpg", "book_beta/p2.jpg", "book_beta/p4.jpg"]
    got = {r["relative"]: r for r in corpus.encoding_check(spark, tree, 50).collect()}
    assert not got["book_beta/p1.txt"]["valid_utf8"] and got["book_alpha/p2.txt"]["is_nfc"] is False and got["book_alpha/p1.txt"]["n_chars"] == 3
    assert corpus.encoding_check(spark, tree, 2).count() == 2


def test_transcriptions(spark, tmp_path):
    page = tmp_path / "out" / "claude_raw" / "book a" / "page_1.txt"
    page.parent.mkdir(parents=True)
    page.write_text("two\nlines")
    assert [tuple(r) for r in corpus.transcriptions(spark, str(tmp_path / "out")).collect()] == [("claude_raw", "book a", "page_1", "two\nlines")]


def scores(spark, n=4):
    return spark.createDataFrame([("b", str(i), "m", "raw", i / 10, None) for i in range(n)], schemas.SCORE)


def test_csv_round_trip_and_resume(spark, tmp_path):
    path = str(tmp_path / "scores")
    assert corpus.finished_keys(spark, path, schemas.SCORE).count() == 0
    sinks.score_csv(scores(spark), path, one_file=True)
    back = corpus.csv(spark, path, schemas.SCORE)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, scores(spark).collect()))
    done = corpus.finished_keys(spark, path, schemas.SCORE)
    assert done.count() == 4
    more = str(tmp_path / "more")
    sinks.append_new(scores(spark, 6), done, more)
    assert sorted(r["page_id"] for r in corpus.csv(spark, more, schemas.SCORE).collect()) == ["4", "5"]
    with pytest.raises(Exception):
        corpus.csv(spark, str(tmp_path / "no"), schemas.SCORE).collect()


def test_other_sinks(spark, tmp_path, tree):
    found, bad = corpus.inventory(spark, tree)
    assert sinks.mismatch_report(bad, str(tmp_path / "bad")) == 4
    assert sinks.mismatch_report(bad.filter("false"), str(tmp_path / "none")) == 0
    assert (tmp_path / "none" / "_SUCCESS").exists() and not "".join(p.read_text() for p in (tmp_path / "none").glob("part*"))
    sinks.inventory_csv(found, str(tmp_path / "inv"), "/elsewhere", one_file=True)
    assert corpus.csv(spark, str(tmp_path / "inv"), schemas.PAGE_INVENTORY).count() == 3
    rows = spark.createDataFrame([("p", "b", "m", None, None, None, "E: x")], schemas.MANIFEST)
    sinks.manifest(rows, str(tmp_path / "m"))
    line = json.loads("".join(p.read_text() for p in (tmp_path / "m").glob("part*")))
    assert line["error"] == "E: x" and line["latency_ms"] is None
    sinks.json_object(spark.createDataFrame([(1, "é")], "a int, b string"), str(tmp_path / "j"))
    assert json.loads("".join(p.read_text() for p in (tmp_path / "j").glob("part*"))) == {"a": 1, "b": "é"}
    texts = spark.createDataFrame([("b1", "p", "m", "raw", "t"), ("b2", "p", "m", "raw", "t")], schemas.TRANSCRIPTION)
    sinks.page_texts(texts, str(tmp_path / "t"))
    assert (tmp_path / "t" / "book_id=b1").is_dir() and spark.read.parquet(str(tmp_path / "t")).count() == 2
    files = spark.createDataFrame([("o", "i2", 1), ("o", "i1", 2)], "output_path string, input_path string, x int")
    assert [r["input_path"] for r in sinks.images(files, str(tmp_path / "img")).collect()] == ["i2"]
    chosen = found.limit(1).select("book_id", "page_id")
    sinks.copied_subset(found, chosen, str(tmp_path / "sub"))
    assert spark.read.parquet(str(tmp_path / "sub")).count() == 1
    with pytest.raises(FileNotFoundError):
        sinks.copied_subset(found, spark.createDataFrame([("x", "y")], "book_id string, page_id string"), str(tmp_path / "sub2"))
    tags = spark.createDataFrame([("b", "2", "Clean", False, "i", "t"), ("b", "1", "Clean", False, "i", "t")], schemas.EVAL_SUBSET)
    sinks.eval_csv(tags, str(tmp_path / "eval"), one_file=True)
    assert [r["page_id"] for r in corpus.csv(spark, str(tmp_path / "eval"), schemas.EVAL_SUBSET).collect()] == ["1", "2"]


def test_log_lines(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"ts": "t", "level": "INFO", "logger": "l", "msg": "m", "page": "p", "ms": 3}\nbroken\n')
    (row,) = corpus.log_lines(spark, str(tmp_path / "log.jsonl")).filter("level is not null").collect()
    assert row["msg"] == "m" and row["extras"] == {"page": "p", "ms": "3"}


def test_streams_take_each_key_once(spark, tmp_path):
    source, sink, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    scores(spark, 3).write.option("header", "true").csv(source)
    incremental.append_once(incremental.read_scores(spark, source), sink, mark).awaitTermination()
    scores(spark, 5).write.mode("append").option("header", "true").csv(source)
    incremental.append_once(incremental.read_scores(spark, source), sink, mark).awaitTermination()
    assert sorted(r["page_id"] for r in spark.read.parquet(sink).collect()) == ["0", "1", "2", "3", "4"]
    other = str(tmp_path / "other")
    for k in range(2):
        incremental.append_missing(incremental.read_scores(spark, source), other, str(tmp_path / f"m{k}")).awaitTermination()
    assert spark.read.parquet(other).count() == 5


def test_stream_state_has_an_end(spark, tmp_path):
    """Keys of the last hour are known; older ones are forgotten, and rows that are too late are dropped."""
    source, sink, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    schema = "k string, at timestamp, n int"
    seen = []
    for n, batch in enumerate([[(f"a{i}", "10:00") for i in range(50)], [("a1", "10:20"), ("b1", "10:30")], [("c1", "13:00")], [("a2", "13:10"), ("c1", "13:20"), ("late", "09:00")], [("d1", "18:00")], [("d2", "18:01")]]):
        spark.createDataFrame([(k, f"2024-01-01 {t}:00", n) for k, t in batch], "k string, t string, n int").selectExpr("k", "cast(t as timestamp) at", "n").coalesce(1).write.mode("append").parquet(source)
        query = incremental.append_recent(spark.readStream.schema(schema).parquet(source), sink, mark, "at", "1 hour", ("k",))
        query.awaitTermination()
        seen.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    got = sorted((r["k"], r["n"]) for r in spark.read.schema(schema).parquet(sink).collect())
    assert [g for g in got if g[0] in ("a1", "b1", "c1", "late", "d1", "d2")] == [("a1", 0), ("b1", 1), ("c1", 2), ("d1", 4), ("d2", 5)]
    assert [n for k, n in got if k == "a2"] == [0, 3]  # known at 10:00, forgotten by 13:10
    assert max(seen) <= 52 and seen[-1] <= 3


def test_folders(spark):
    df = spark.createDataFrame([("a/x",), ("a/y",), ("b/z",), ("root",)], "path string")
    assert sorted(r[0] for r in corpus.top_folders(df).collect()) == ["a", "b"]
    assert df.select(corpus.unit(F.lit(2048))).first()[0] == 2.0
