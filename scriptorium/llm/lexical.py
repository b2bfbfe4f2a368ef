"""Ranked lexical search by windowed bucket scoring (operator 13).

``index`` turns documents into windows of at most ``WINDOW`` consecutive documents of a task, numbered
from 0 in each, so that a window's scores fit a core's cache. A window is a row: ids and sizes of its
documents, its terms (64-bit hashes, in order), and the postings (document's number, occurrences) of
one term after the other. Documents aren't shuffled; only windows are written.

``search`` takes the items in blocks. It reads N, L and the document frequencies off the index, then
traverses the windows: of each item's terms the postings' weights are scatter-added into an array with
a cell for each document of the window, beside a bitset of the cells in use; what the bitset marks is
harvested into the item's heap and wiped. Every task ends with a heap for each item, and a window
function picks each item's best of those.

All arithmetic but the logarithm is on 64-bit integers, as the weights' definition wants it: a term's
is floor(1000 ln((2N + 2) / (2 df + 1))), a posting adds weight * ((10^9 tf) div (1000 tf + 8 m)), and
m is 10 + ((90 n N) div L) for a document of n terms.

Cases: terms are maximal runs of ASCII letters and digits and of characters beyond ASCII, with A-Z in
lower case. Documents without terms (null and empty texts) count nowhere and are never found; items
without terms find nothing. Documents of any length are indexed whole, repeated ones each, and equal
scores go by ascending id, nulls last. Ids may repeat or be null. Repeated items (id and text) are one; an
id with several texts has a ranking for each. No documents or no items give no rows. Only the named
columns are read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.decontaminate import word_lists
from scriptorium.llm.support import arrow_map, gathered, list_array, sized, written

#: Documents of a window, and postings after which one is closed early.
WINDOW, POSTINGS = 8192, 1 << 20
TOP = 10
#: Bytes of the items of a block, which goes to every task.
BLOCK_BYTES = 8 << 20
#: Distinct terms of the items up to which only their postings are indexed (their hashes are broadcast); beyond, all are.
MAX_TERMS = 1 << 20


def term_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes of all terms, joined; number of terms of each text; hash of each code)."""
    words, counts = word_lists(column)
    coded = words.dictionary_encode()
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
    return coded.indices.to_numpy().astype(np.int64), counts, own


def _held(sorted_hashes: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which of ``of`` are among ``sorted_hashes``."""
    if not len(sorted_hashes):
        return np.zeros(len(of), bool)
    return sorted_hashes[np.minimum(np.searchsorted(sorted_hashes, of), len(sorted_hashes) - 1)] == of


def postings(column: pa.Array, only: np.ndarray | None = None) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The number of terms of each text, and (hash, text's number, occurrences) of each term in each text."""
    codes, counts, own = term_lists(column)
    docs = np.repeat(np.arange(len(counts)), counts)
    if only is not None:
        wanted = _held(only, own)[codes] if len(own) else np.zeros(0, bool)
        codes, docs = codes[wanted], docs[wanted]
    keys, times = np.unique(codes * len(counts) + docs, return_counts=True)
    return counts, (own[keys // max(len(counts), 1)], keys % max(len(counts), 1), times)


def index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", only: np.ndarray | None = None, window: int = WINDOW, most: int = POSTINGS) -> DataFrame:
    """(ids, sizes, terms, ends, docs, times): a row for each window. ``only``: sorted hashes of the terms to index; sizes count all terms."""
    source = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).filter("text is not null")
    sent = None if only is None else docs.sparkSession.sparkContext.broadcast(only)

    def closed(held: list) -> pa.RecordBatch:
        ids, sizes, hashes, numbers, times = ([h[i] for h in held] for i in range(5))
        base = np.cumsum([0, *(len(s) for s in sizes)])
        every = np.concatenate([n + b for n, b in zip(numbers, base[:-1], strict=True)])
        terms, times = np.concatenate(hashes), np.concatenate(times)
        order = np.lexsort((every, terms))
        distinct, first = np.unique(terms[order], return_index=True)
        one = lambda values, kind: list_array(values, np.array([len(values)]), kind)
        known = pa.concat_arrays(ids)
        columns = [pa.ListArray.from_arrays(pa.array([0, len(known)], pa.int32()), known), one(np.concatenate(sizes), pa.int64()), one(distinct.view(np.int64), pa.int64()), one(np.append(first[1:], len(order)).astype(np.int32)[: len(distinct)], pa.int32()), one(every[order].astype(np.int32), pa.int32()), one(times[order].astype(np.int64), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["ids", "sizes", "terms", "ends", "docs", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if sent is None else sent.value
        held, rows, size = [], 0, 0
        for batch in sized(gathered(batches, "text", 2 << 20), "text"):
            counts, (hashes, numbers, times) = postings(batch.column(1), wanted)
            some = np.flatnonzero(counts)
            new = np.cumsum(counts > 0) - 1  # documents without a term have no number
            ids, sizes, numbers = batch.column(0).take(pa.array(some)), counts[some], new[numbers]
            # Batches are cut where a window is full.
            for start in range(0, len(some), window):
                stop = min(start + window, len(some))
                if held and (rows + stop - start > window or size >= most):
                    yield closed(held)
                    held, rows, size = [], 0, 0
                mine = (numbers >= start) & (numbers < stop)
                held.append((ids.slice(start, stop - start), sizes[start:stop], hashes[mine], numbers[mine] - start, times[mine]))
                rows, size = rows + stop - start, size + int(mine.sum())
        if held:
            yield closed(held)

    return arrow_map(source, run, f"ids array<{source.schema['id'].dataType.simpleString()}>, sizes array<long>, terms array<long>, ends array<int>, docs array<int>, times array<long>")


def totals(windows: DataFrame) -> tuple[int, int]:
    """N and L: documents with a term, and all their terms."""
    row = windows.agg(F.sum(F.size("sizes").cast("long")), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    return row[0] or 0, row[1] or 0


def frequencies(windows: DataFrame) -> DataFrame:
    """(term, df): how many documents hold each indexed term."""
    each = F.transform("terms", lambda t, i: F.struct(t.alias("term"), (F.get("ends", i) - F.when(i > 0, F.get("ends", i - 1)).otherwise(0)).cast("long").alias("df")))
    return windows.select(F.inline(each)).groupBy("term").agg(F.sum("df").alias("df"))


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def blocks(items: DataFrame, block_bytes: int) -> Iterator[list]:
    """Distinct items (id, text) in blocks of about ``block_bytes`` at most; an item is never cut."""
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(2 * size / block_bytes))
    for g in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == g)
        if rows := part.collect():
            yield [(r["id"], r["text"]) for r in rows]


def prepared(rows: list) -> SimpleNamespace:
    """Items of a block: their ids, the sorted hashes of all their terms, room for the weight of each, and each item's terms by place among them."""
    codes, counts, own = term_lists(pa.array([t for _, t in rows], pa.large_string()))
    terms, ends = np.sort(own), np.cumsum(counts)
    place = np.searchsorted(terms, own)
    of = [np.unique(place[codes[e - c : e]]) for c, e in zip(counts, ends, strict=True)]
    return SimpleNamespace(ids=[i for i, _ in rows], terms=terms, of=of, weights=np.zeros(len(own), np.int64))


def scored(row: dict, block: SimpleNamespace, n: int, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start and end of each block's term among the window's postings, what each posting adds)."""
    terms = row["terms"].view(np.uint64)
    at = np.minimum(np.searchsorted(terms, block.terms), max(len(terms) - 1, 0))
    here = terms[at] == block.terms if len(terms) else np.zeros(len(block.terms), bool)
    starts = np.concatenate([[0], row["ends"][:-1]])
    lo, hi = (np.where(here, x[at], 0) if len(terms) else np.zeros(len(here), np.int64) for x in (starts, row["ends"]))
    m = 10 + (90 * row["sizes"] * n) // total
    adds = (1_000_000_000 * row["times"]) // (1000 * row["times"] + 8 * m[row["docs"]])
    for term in np.flatnonzero(here):
        adds[lo[term] : hi[term]] *= block.weights[term]
    return lo, hi, adds


def harvest(heap: list, cells: np.ndarray, scores: np.ndarray, ids: pa.Array, k: int) -> list:
    """The ``k`` best of ``heap`` and the window's marked cells, as (score with its sign turned, null id, id)."""
    floor = -heap[-1][0] if len(heap) == k else 1
    good = cells[scores >= max(floor, 1)]
    if not len(good):
        return heap
    mine = scores[scores >= max(floor, 1)]
    if len(good) > k:  # ties with the k-th stay, as their ids decide
        least = np.partition(mine, len(mine) - k)[len(mine) - k]
        good, mine = good[mine >= least], mine[mine >= least]
    named = ids.take(pa.array(good)).to_pylist()
    return heapq.nsmallest(k, [*heap, *((-int(s), i is None, i if i is not None else 0) for s, i in zip(mine, named, strict=True))])


def search_block(windows: DataFrame, rows: list, n: int, total: int, k: int, kinds: tuple[str, str]) -> DataFrame:
    """(number, item, id, score): the best of each task for each item of the block."""
    spark, block = windows.sparkSession, prepared(rows)
    terms = spark.createDataFrame([(int(t),) for t in block.terms.view(np.int64)], "term long")
    for r in frequencies(windows).join(terms, "term", "left_semi").collect():
        block.weights[np.searchsorted(block.terms, np.array([r["term"]]).view(np.uint64))[0]] = weight(n, r["df"])
    sent = spark.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        heaps: list[list] = [[] for _ in own.ids]
        for batch in batches:
            for r in range(len(batch)):
                row = {c: batch.column(batch.schema.get_field_index(c))[r].values for c in batch.schema.names}
                ids, row = row["ids"], {c: v.to_numpy(zero_copy_only=False) for c, v in row.items() if c != "ids"}
                lo, hi, adds = scored(row, own, n, total)
                score, used = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
                for i, wanted in enumerate(own.of):
                    for term in wanted[hi[wanted] > lo[wanted]]:
                        docs = row["docs"][lo[term] : hi[term]]
                        score[docs] += adds[lo[term] : hi[term]]
                        used[docs] = True
                    cells = np.flatnonzero(used)
                    heaps[i] = harvest(heaps[i], cells, score[cells], ids, k)
                    score[cells], used[cells] = 0, False
        every = [(i, None if none else x, -s) for i, heap in enumerate(heaps) for s, none, x in heap]
        number, found, scores = (list(x) for x in zip(*every, strict=True)) if every else ([], [], [])
        yield pa.RecordBatch.from_pydict({"number": pa.array(number, pa.int32()), "id": pa.array(found, id_kind), "score": pa.array(scores, pa.int64())})

    from pyspark.sql.pandas.types import to_arrow_type

    id_kind = to_arrow_type(windows.schema["ids"].dataType.elementType)
    found = arrow_map(windows, run, f"number int, id {kinds[0]}, score long")
    names = spark.createDataFrame([(i, x) for i, x in enumerate(block.ids)], f"number int, item {kinds[1]}")
    best = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).join(names, "number").select("item", "rank", "id", "score")


def vocabulary(items: DataFrame) -> np.ndarray | None:
    """The sorted hashes of the items' terms; None if there are more than ``MAX_TERMS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(term_lists(batch.column(0))[2]).view(np.int64))], names=["term"])

    rows = arrow_map(items.select("text"), run, "term long").distinct().limit(MAX_TERMS + 1).collect()
    return None if len(rows) > MAX_TERMS else np.sort(np.array([r["term"] for r in rows], np.int64).view(np.uint64))


def search(docs: DataFrame, items: DataFrame, k: int = TOP, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item with a score above 0."""
    spark = docs.sparkSession
    asked = items.select(F.col(item_id).alias("id"), F.col(item_text).alias("text")).filter("text is not null").distinct()
    windows = written(index(docs, doc_id, text, vocabulary(asked)), "lexical-index")
    n, total = totals(windows)
    kinds = (windows.schema["ids"].dataType.elementType.simpleString(), asked.schema["id"].dataType.simpleString())
    frames = [search_block(windows, rows, n, total, k, kinds) for rows in blocks(asked, block_bytes)] if total else []
    out = spark.createDataFrame([], f"item {kinds[1]}, rank int, id {kinds[0]}, score long")
    for frame in frames:
        out = out.unionByName(frame)
    return out.select(F.col("item").alias(item_id), "rank", F.col("id").alias(doc_id), "score")
