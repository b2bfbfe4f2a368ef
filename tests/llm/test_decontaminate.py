import random
import re
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import decontaminate
from scriptorium.llm.support import sized


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for name, item in items:
        v = words(item)
        n = min(10, len(v))
        windows = {tuple(v[j : j + n]) for j in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1) if n else ():
            if tuple(w[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(str(name))
    return len(w), len(hit), sorted(found)


def longest(text, item):
    a, b = words(text), words(item)
    best = 0
    for i in range(len(a)):
        for j in range(len(b)):
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            best = max(best, k)
    return best


def cases():
    rng = random.Random(3)
    vocabulary = ["a", "B", "c", "dé", "é9", "x1"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", "\n", "-", "...", "\x00"]) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 5, 9, 10, 12, 25]))) for i in range(20)] + [(100, ""), (101, None), (7, "a a a a a a a a a a a a")]
    docs = [text(rng.randint(0, 60)) for _ in range(150)] + [t for _, t in items] + ["a " * 500, text(5) + (items[3][1] or "") + text(5)]
    return docs, items


def test_against_brute_force(spark, make_docs, nasty):
    docs, items = cases()
    docs = docs + nasty
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.find(make_docs(docs), bench).collect()}
    for i, t in enumerate(docs):
        n, hit, found = brute(t, items)
        r = got[i]
        assert (r["n_words"], sum(h["end"] - h["start"] for h in r["hits"]), sorted(set(r["items"]))) == (n, hit, found), t


def test_longest_matches(spark, make_docs):
    docs = ["one two three four five six seven eight nine ten eleven twelve x", "zero one two three four five six seven eight nine ten"]
    item = "q one two three four five six seven eight nine ten eleven twelve thirteen"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    for r in decontaminate.find(make_docs(docs), bench).collect():
        (m,) = r["matches"]
        assert m["n_words"] == longest(docs[r["doc_id"]], item) and (m["doc_start"], m["item_start"]) == (r["doc_id"], 1)


def test_every_location_has_its_longest_match(spark, make_docs):
    item = " ".join(f"w{i}" for i in range(30))
    part = lambda a, b: " ".join(item.split()[a:b])
    text = f"{part(0, 12)} x {part(5, 30)} y {part(3, 12)} z {item} {item}"
    bench = spark.createDataFrame([(1, item), (1, item), (2, part(2, 14))], "item_id long, text string")
    (row,) = decontaminate.find(make_docs([text]), bench).collect()
    assert row["items"] == ["1", "2"]
    got = {(m["item"], m["doc_start"], m["item_start"], m["n_words"]) for m in row["matches"]}
    assert {m for m in got if m[0] == "1"} == {("1", 0, 0, 12), ("1", 13, 5, 25), ("1", 49, 0, 30)}  # copies that touch are one stretch
    assert {m for m in got if m[0] == "2"} == {("2", 2, 0, 10), ("2", 51, 0, 12), ("2", 81, 0, 12)}
    with pytest.raises(ValueError, match="items"):
        decontaminate.find(make_docs([text]).withColumn("items", F.lit(1)), bench, keep=("items",))


def test_blocks_give_the_same(spark, make_docs):
    docs, items = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = decontaminate.digest(decontaminate.find(make_docs(docs), bench)).orderBy("doc_id").collect()
    many = decontaminate.digest(decontaminate.find(make_docs(docs), bench, block_bytes=200)).orderBy("doc_id").collect()
    assert one == many


def test_empty_inputs_and_clean(spark, make_docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find(make_docs(["a b"]), bench).collect()[0]["n_words"] == 2
    assert decontaminate.find(make_docs([]), bench).count() == 0
    bench = spark.createDataFrame([(1, "bad item")], "item_id long, text string")
    docs = make_docs(["a BAD item here", "fine", None], [1, 1, None])
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r["text"] or "" for r in kept.collect()) == ["", "fine"]


def test_slices_of_a_batch():
    docs, items = cases()
    index = decontaminate.make_index(items)
    whole = decontaminate.match_shard(pa.array(docs), index)[1]
    parts = [x for b in sized([pa.RecordBatch.from_arrays([pa.array(docs)], names=["text"])], "text", 300) for x in decontaminate.match_shard(b.column(0), index)[1]]
    assert whole == parts


def outermost(text, items):
    """(start, words) of the longest match at each place, without those within another."""
    w, out, reach = words(text), [], 0
    for i in range(len(w)):
        best = 0
        for _, item in items:
            v = words(item)
            for j in range(len(v)):
                k = 0
                while i + k < len(w) and j + k < len(v) and w[i + k] == v[j + k]:
                    k += 1
                if k >= 10 or 0 < k == len(v):
                    best = max(best, k)
        if i + best > reach and best:
            out.append((i, best))
            reach = i + best
    return out


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 200])
def test_longest_at_each_place(spark, make_docs, block_bytes):
    docs, items = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    by_name = {}
    for name, item in items:
        by_name.setdefault(str(name), []).append(words(item))
    each = {r["doc_id"]: r for r in decontaminate.find(make_docs(docs), bench).collect()}
    for r in decontaminate.find(make_docs(docs), bench, block_bytes=block_bytes, each_item=False).collect():
        text = docs[r["doc_id"]]
        assert [(m["doc_start"], m["n_words"]) for m in r["matches"]] == outermost(text, items), text
        for m in r["matches"]:
            part = words(text)[m["doc_start"] : m["doc_start"] + m["n_words"]]
            assert any(v[m["item_start"] : m["item_start"] + len(part)] == part for v in by_name[m["item"]])
        assert (r["hits"], sorted(r["items"])) == (each[r["doc_id"]]["hits"], sorted(each[r["doc_id"]]["items"]))


def test_order_of_suffixes():
    rng = np.random.default_rng(4)
    for _ in range(20):
        codes = rng.integers(0, 3, 200)
        follows = rng.random(200) < 0.9
        follows[0] = False
        starts, room = decontaminate.runs_of(follows)
        suffixes = [tuple(codes[i : i + room[i]]) for i in range(200)]
        levels = decontaminate.ranked(codes, room)
        order = {t: k for k, t in enumerate(sorted(set(suffixes)))}
        assert levels[-1].tolist() == [order[t] for t in suffixes]
        a, b = rng.integers(0, 200, 500), rng.integers(0, 200, 500)
        alike = [next((k for k, (x, y) in enumerate(zip(suffixes[i], suffixes[j])) if x != y), min(room[i], room[j])) for i, j in zip(a, b)]
        assert decontaminate.common(levels, room, a, b).tolist() == alike
        runs = [tuple(codes[s : s + room[s]]) for s in starts]
        assert [runs[k] for k in decontaminate.distinct_runs(codes, starts)] == list(dict.fromkeys(runs))


SHARED_PROMPT = """
import random, resource
import pyarrow as pa
from scriptorium.llm import decontaminate
rng = random.Random(1)
word = lambda: f"w{rng.randrange(5000)}"
prompt = " ".join(f"p{i}" for i in range(30))
items = [(str(i), prompt + " " + " ".join(word() for _ in range(20))) for i in range(20_000)]
index = decontaminate.make_index(items)
texts = [" x ".join([prompt] * 2000), items[7][1], "clean " * 50]
counts, runs, names, matches = decontaminate.match_shard(pa.array(texts), index, "place")
assert [len(n) for n in names] == [20_000, 20_000, 0], [len(n) for n in names]
assert [len(m) for m in matches] == [2000, 1, 0]
assert {m["n_words"] for m in matches[0]} == {30} and matches[1] == [{"item": "7", "doc_start": 0, "item_start": 0, "n_words": 50}]
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""


def test_items_that_share_a_prompt_stay_small():
    """20,000 items with one prompt that a document repeats 2000 times: 40 million pairs, none of which is made."""
    done = subprocess.run([sys.executable, "-c", SHARED_PROMPT], capture_output=True, text=True, check=False, timeout=300)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) < 1000
