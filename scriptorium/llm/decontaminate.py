"""Benchmark decontamination with training suffix arrays (operator 2).

Documents form shards (an Arrow batch each). Every shard gets a word-level suffix array of the
positions at which some test suffix can match: a position whose first words don't occur in any item
can't be in a match, so leaving it out changes nothing. The array is sorted by the ``WINDOW`` words that
follow, and the windows of the benchmark are binary-searched in it. Positions at which one occurs are
then ordered by all that follows, to the end of the stretch of such positions, by doubling over the
windows' numbers, and every test suffix that has a window in the shard is binary-searched in that order;
its neighbours give the longest verbatim matches. Documents never leave their task: only matches and
counts do.

``matches`` holds each item's longest match in each stretch of the document that the item's windows
cover; there are as many as items times occurrences, if items share windows. Without ``each_item`` it
holds the longest match at each place of the document, those that don't lie within another, each with
one item that holds it: what a task holds then goes with the words of its shard and of the benchmark's
block only.

Words: A-Z is lower-cased, then runs of digits, letters a-z and non-ASCII characters. A window is
``WINDOW`` consecutive words of an item, or a whole item of fewer (but some) words.

The benchmark's distinct items are collected in blocks of about ``BLOCK_BYTES`` (an item is never cut,
so a block with a larger one is larger), so what is broadcast doesn't grow with their number; the
blocks' matches are merged by document.

Cases: null or empty texts have no words and no matches; items without words match nothing.
Repeated documents are each reported, repeated items once; items that share an id count as one item.
Ids may be null. Only the named columns are read; ``keep`` may hold any names but the result's own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.support import arrow_map, sized, texts

WINDOW = 10
#: Words by which positions are chosen for the suffix array.
ANCHOR = 4
BLOCK_BYTES = 8 << 20
#: Items' ids in a batch that leaves a task, and holders of windows looked at together.
OUT_ITEMS = 1 << 19

_TABLE = np.full(256, 32, dtype=np.uint8)
_TABLE[48:58] = np.arange(48, 58)
_TABLE[97:123] = np.arange(97, 123)
_TABLE[65:91] = np.arange(97, 123)
_TABLE[128:] = np.arange(128, 256)

MATCHES = "array<struct<item:string,doc_start:int,item_start:int,n_words:int>>"
SCHEMA = f"__text long, n_words long, hits array<struct<start:int,end:int>>, items array<string>, matches {MATCHES}"


def word_lists(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a column of texts, joined, and the number of words of each text."""
    column = texts(column)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    clean = pa.LargeStringArray.from_buffers(len(column), pa.py_buffer((ends - (ends[0] if len(ends) else 0)).tobytes()), pa.py_buffer(_TABLE[raw].tobytes()))
    lists = pc.ascii_split_whitespace(clean)
    words = lists.flatten()
    real = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(real)])
    at = lists.offsets.to_numpy()
    at = at - at[0]
    return words.filter(pa.array(real)), (starts[at[1:]] - starts[at[:-1]]).astype(np.int64)


@dataclass
class Windows:
    """The windows of one length: distinct keys in order, and each test suffix (by item, then start) as the number of its first window."""

    distinct: np.ndarray
    anchors: np.ndarray
    item: np.ndarray
    start: np.ndarray
    code: np.ndarray
    #: Test suffixes by window, and where each window's begin.
    order: np.ndarray
    first: np.ndarray
    #: Distinct names of the items with each window, by window, and where each window's begin.
    holders: np.ndarray
    held_from: np.ndarray


@dataclass
class Index:
    """A block of the benchmark: names of its items, its vocabulary, its windows by length."""

    names: list
    #: The distinct names, and each item's place among them.
    distinct_names: pa.Array
    named: np.ndarray
    vocabulary: pa.Array
    windows: dict


def keys_at(ids: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """The ``length`` ids from each start as bytes that sort as the ids do. Ids are 0 or more; 1 is added so that no key ends in zeros only by its words."""
    block = (ids[starts[:, None] + np.arange(length)] + 1).astype(">u4")
    return np.ascontiguousarray(block).view(f"S{4 * length}").ravel()


def spread(first: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all members of the chosen groups, and the size of each group, where ``first`` says where groups begin."""
    sizes = first[which + 1] - first[which]
    return np.repeat(first[which] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum()), sizes


def make_index(items: list[tuple], window: int = WINDOW) -> Index:
    words, counts = word_lists(pa.array([t for _, t in items], type=pa.large_string()))
    coded = words.dictionary_encode()
    ids = coded.indices.to_numpy().astype(np.int64)
    begins = np.cumsum(counts) - counts
    codes: dict = {}
    named = np.array([codes.setdefault(n, len(codes)) for n, _ in items], dtype=np.int64)
    windows = {}
    sizes = np.minimum(counts, window)
    for length in np.unique(sizes[sizes > 0]).tolist():
        mine = np.flatnonzero(sizes == length)
        n = counts[mine] - length + 1
        item = np.repeat(mine, n)
        start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        distinct, code = np.unique(keys_at(ids, begins[item] + start, length), return_inverse=True)
        edges = np.arange(len(distinct) + 1)
        order = np.argsort(code, kind="stable")
        held = np.unique(code * len(codes) + named[item])
        depth = min(length, ANCHOR)
        anchors = np.unique(distinct.astype(f"S{4 * length}").view("S4").reshape(-1, length)[:, :depth].copy().view(f"S{4 * depth}").ravel())
        windows[length] = Windows(distinct, anchors, item, start, code, order, np.searchsorted(code[order], edges), held % len(codes), np.searchsorted(held // len(codes), edges))
    return Index([n for n, _ in items], pa.array([None if n is None else str(n) for n in codes], pa.string()), named, coded.dictionary, windows)


def suffix_array(ids: np.ndarray, room: np.ndarray, length: int, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shard's positions with ``length`` words left in their document and a first few words that some window begins with, sorted by the words that follow, and the sorted keys."""
    depth = min(length, ANCHOR)
    known = ids >= 0
    ok = room >= length
    for d in range(depth):
        ok[: len(ids) - d] &= known[d:]
    at = np.flatnonzero(ok)
    for part in range(1, depth + 1):  # the cheap check of few words first
        firsts = np.unique(anchors.view("S4").reshape(-1, depth)[:, :part].copy().view(f"S{4 * part}").ravel())
        at = at[np.isin(_codes(keys_at(ids, at, part), part), _codes(firsts, part))]
    at = at[(ids[at[:, None] + np.arange(length)] >= 0).all(axis=1)] if len(at) else at
    keys = keys_at(ids, at, length)
    order = np.argsort(keys, kind="stable")
    return at[order], keys[order]


def _codes(keys: np.ndarray, part: int) -> np.ndarray:
    """Keys of one or two words as integers, which compare faster."""
    if part > 2 or not len(keys):
        return keys
    return keys.view(">u4" if part == 1 else ">u8").astype(np.uint64)


def merge_runs(starts: np.ndarray, ends: np.ndarray) -> list[dict]:
    """Overlapping or adjoining word ranges as maximal ones."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    return [{"start": int(s), "end": int(e)} for s, e in zip(starts[new], ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)], strict=True)]


def longest(items: np.ndarray, starts: np.ndarray, places: np.ndarray, length: int) -> list[tuple[int, int, int, int]]:
    """Of hits (item, start in the item, place in the document) of windows of one length, each item's longest match in each stretch that its hits cover: (item, place, start, words)."""
    diagonal = places - starts
    order = np.lexsort((starts, diagonal, items))
    items, starts, places, diagonal = items[order], starts[order], places[order], diagonal[order]
    fresh = np.concatenate([[True], (items[1:] != items[:-1]) | (diagonal[1:] != diagonal[:-1]) | (starts[1:] != starts[:-1] + 1)])
    first = np.flatnonzero(fresh)
    words = np.diff(np.append(first, len(items))) - 1 + length
    by_place = np.lexsort((places[first], items[first]))
    first, words = first[by_place], words[by_place]
    item, begin = items[first], places[first]
    # Ends are raised item by item, so that one item's reach doesn't touch the next one's.
    room = int((begin + words).max()) + 1
    reach = np.maximum.accumulate(begin + words + item * room)
    stretch = np.cumsum(np.concatenate([[True], (item[1:] != item[:-1]) | (begin[1:] + item[1:] * room > reach[:-1])]))
    best = np.lexsort((starts[first], begin, -words, stretch))
    top = best[np.concatenate([[True], stretch[best][1:] != stretch[best][:-1]])]
    return [(int(item[k]), int(begin[k]), int(starts[first[k]]), int(words[k])) for k in top]


def runs_of(follows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs begin, if ``follows`` says which elements continue the one before, and how many elements of its run each has from itself on."""
    starts = np.flatnonzero(~follows)
    sizes = np.diff(np.append(starts, len(follows)))
    return starts, np.repeat(starts + sizes, sizes) - np.arange(len(follows))


def distinct_runs(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The numbers of the first run of each set of equal ones. Runs are grouped by a hash, then compared with their group's first; one that differs stays."""
    sizes = np.diff(np.append(starts, len(codes)))
    offset = np.arange(len(codes)) - np.repeat(starts, sizes)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(sizes.max()), 0x9E3779B97F4A7C15, dtype=np.uint64))
        mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        value = np.add.reduceat((mixed ^ (mixed >> np.uint64(32))) * powers[offset], starts)
    order = np.lexsort((value, sizes))
    head = np.concatenate([[True], (value[order][1:] != value[order][:-1]) | (sizes[order][1:] != sizes[order][:-1])])
    chief = np.empty(len(starts), dtype=np.int64)
    chief[order] = order[np.flatnonzero(head)[np.cumsum(head) - 1]]
    same = np.logical_and.reduceat(codes == codes[np.repeat(starts[chief], sizes) + offset], starts)
    return np.flatnonzero((chief == np.arange(len(starts))) | ~same)


def ranked(codes: np.ndarray, room: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4 ... symbols, each suffix ending with its run (``room`` symbols); the last are those by all symbols."""
    levels = [np.unique(codes, return_inverse=True)[1].astype(np.int32)]
    reach, at = 1, np.arange(len(codes))
    while reach < room.max():
        rank = levels[-1].astype(np.int64)
        after = np.where(room > reach, rank[np.minimum(at + reach, len(codes) - 1)] + 1, 0)
        levels.append(np.unique(rank * (rank.max() + 2) + after, return_inverse=True)[1].astype(np.int32))
        reach *= 2
    return levels


def common(levels: list[np.ndarray], room: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of symbols that suffixes ``a`` and ``b`` begin with alike."""
    n = np.zeros(len(a), dtype=np.int64)
    left = np.minimum(room[a], room[b])
    last = len(room) - 1
    for level in range(len(levels) - 1, -1, -1):
        rank, step = levels[level], 1 << level
        n += step * ((left - n >= step) & (rank[np.minimum(a + n, last)] == rank[np.minimum(b + n, last)]))
    return n


def longest_at(window: np.ndarray, room: np.ndarray, known: Windows, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position with a window: the number of windows of its longest match with a test suffix, and that test suffix.

    The positions' suffixes are put in order, and the test suffixes with a window found here (equal stretches of them once) are binary-searched in it."""
    tests = np.sort(known.order[spread(known.first, found)[0]])
    follows = np.concatenate([[False], (tests[1:] == tests[:-1] + 1) & (known.item[tests[1:]] == known.item[tests[:-1]])])
    starts, _ = runs_of(follows)
    kept = distinct_runs(known.code[tests], starts)
    tests = tests[spread(np.append(starts, len(tests)), kept)[0]]
    follows = np.concatenate([[False], (tests[1:] == tests[:-1] + 1) & (known.item[tests[1:]] == known.item[tests[:-1]])])
    n = len(window)
    room = np.concatenate([room, runs_of(follows)[1]])
    levels = ranked(np.concatenate([window, known.code[tests]]), room)
    rank = levels[-1]
    array = np.argsort(rank[:n], kind="stable")
    ranks, suffix = np.unique(rank[n:], return_index=True)
    below = np.cumsum(np.bincount(np.searchsorted(rank[array], ranks), minlength=n + 1))[:n] - 1
    best, which = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for near in (below, below + 1):
        there = np.flatnonzero((near >= 0) & (near < len(suffix)))
        test = suffix[near[there]]
        size = common(levels, room, array[there], n + test)
        better = size > best[array[there]]
        best[array[there[better]]], which[array[there[better]]] = size[better], tests[test[better]]
    return best, which


def outermost(found: list[tuple]) -> tuple[np.ndarray, ...]:
    """Of matches (place, words, item, start in it), those that end after all that begin before them, and the longest of each place."""
    place, words, item, start = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((item, -words, place))
    ends = (place + words)[order]
    order = order[np.concatenate([[True], ends[1:] > np.maximum.accumulate(ends)[:-1]])]
    return place[order], words[order], item[order], start[order]


def names_of(known: Windows, windows: np.ndarray, names: np.ndarray) -> np.ndarray:
    """``names`` and those that hold one of the windows, some windows at a time."""
    sizes = known.held_from[windows + 1] - known.held_from[windows]
    for part in np.split(windows, np.flatnonzero(np.diff(np.cumsum(sizes) // OUT_ITEMS)) + 1):
        names = np.union1d(names, known.holders[spread(known.held_from, part)[0]])
    return names


def match_shard(column: pa.Array, index: Index, matches: str = "item") -> tuple[np.ndarray, list, list, list]:
    """Of each text of the shard: the number of words, hit ranges, names of items with windows in it (as places among the distinct names), longest matches.

    ``matches`` says whether those are by "item" or by "place", or whether only hits are wanted ("none")."""
    words, counts = word_lists(column)
    ids = pc.fill_null(pc.index_in(words, value_set=index.vocabulary.cast(words.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(counts)
    room = np.repeat(ends, counts) - np.arange(len(ids))
    begins = ends - counts
    hits: list[list] = [[] for _ in counts]
    names = [np.zeros(0, dtype=np.int64) for _ in counts]
    result: list[list] = [[] for _ in counts]
    longest_found = []
    for length, known in index.windows.items():
        at, keys = suffix_array(ids, room, length, known.anchors)
        if not len(at):
            continue
        low, high = np.searchsorted(keys, known.distinct, "left"), np.searchsorted(keys, known.distinct, "right")
        found = np.flatnonzero(high > low)
        if not len(found):
            continue
        n = high[found] - low[found]
        window = np.repeat(found, n)
        place = at[np.repeat(low[found] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        order = np.argsort(place)
        window, place = window[order], place[order]
        doc = np.searchsorted(ends, place, side="right")
        if matches == "place":
            follows = np.concatenate([[False], (place[1:] == place[:-1] + 1) & (doc[1:] == doc[:-1])])
            size, test = longest_at(window, runs_of(follows)[1], known, found)
            longest_found.append((place, size + length - 1, known.item[test], known.start[test]))
        for lo, hi in zip(*_groups(doc), strict=True):
            d = int(doc[lo])
            mine, local = window[lo:hi], place[lo:hi] - begins[d]
            hits[d].append((local, local + length))
            if matches != "none":
                names[d] = names_of(known, np.unique(mine), names[d])
            if matches == "item":
                spot, times = spread(known.first, mine)
                result[d] += longest(known.item[known.order[spot]], known.start[known.order[spot]], np.repeat(local, times), length)
    runs = [merge_runs(np.concatenate([s for s, _ in h]), np.concatenate([e for _, e in h])) if h else [] for h in hits]
    if longest_found:
        found = outermost(longest_found)
        doc = np.searchsorted(ends, found[0], side="right")
        for d, p, w, i, o in zip(doc.tolist(), (found[0] - begins[doc]).tolist(), *(x.tolist() for x in found[1:]), strict=True):
            result[d].append((i, p, o, w))
    return counts, runs, names, [[{"item": index.names[i], "doc_start": s, "item_start": o, "n_words": w} for i, s, o, w in (m if matches == "place" else sorted(m))] for m in result]


def _groups(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = np.flatnonzero(np.diff(sorted_keys)) + 1
    return np.concatenate([[0], cut]), np.append(cut, len(sorted_keys))


_OUT = pa.struct([("item", pa.string()), ("doc_start", pa.int32()), ("item_start", pa.int32()), ("n_words", pa.int32())])


def blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple]]:
    """The benchmark's items in blocks of about ``block_bytes`` at most."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(2 * total / block_bytes))
    for g in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == g)
        if rows := [(r["item"], r["text"]) for r in part.collect()]:
            yield sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))


def find(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: tuple[str, ...] = (), block_bytes: int = BLOCK_BYTES, each_item: bool = True) -> DataFrame:
    """A row for each document: its id, the columns in ``keep``, n_words, hits (word ranges), items, matches (the longest of each item at each of its locations, or without ``each_item`` the longest at each place).

    With more than one block, the rows of a document are matched up by those columns and a hash of its text."""
    spark, frames = docs.sparkSession, []
    names = list(dict.fromkeys([doc_id, *keep]))
    if clash := {"__text", "n_words", "hits", "items", "matches"} & set(names):
        raise ValueError(f"columns to keep are called like those of the result: {', '.join(sorted(clash))}")
    columns = list(dict.fromkeys([*names, text]))
    source = docs.select(*columns)
    kinds = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    for rows in blocks(benchmark, item_id, item_text, block_bytes):
        sent = spark.sparkContext.broadcast(rows)

        def run(batches, sent=sent):
            index = make_index(sent.value)
            for batch in sized(batches, text):
                counts, runs, items, found = match_shard(batch.column(batch.schema.get_field_index(text)), index, "item" if each_item else "place")
                sizes = np.array([len(i) for i in items], dtype=np.int64)
                cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // OUT_ITEMS)) + 1
                for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)], strict=True):
                    part = batch.slice(lo, hi - lo)
                    own = [None if t is None else xxhash.xxh3_64_intdigest(t) - (1 << 63) for t in part.column(part.schema.get_field_index(text)).to_pylist()]
                    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes[lo:hi])]), pa.int32())
                    held = pa.ListArray.from_arrays(offsets, index.distinct_names.take(pa.array(np.concatenate(items[lo:hi]))))
                    made = [pa.array(own, pa.int64()), pa.array(counts[lo:hi]), pa.array(runs[lo:hi], type=pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), held, pa.array(found[lo:hi], type=pa.list_(_OUT))]
                    yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in names), *made], names=[*names, "__text", "n_words", "hits", "items", "matches"])

        frames.append(arrow_map(source, run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", " + SCHEMA))
    if not frames:
        return find(docs, spark.createDataFrame([("", "")], f"`{item_id}` string, `{item_text}` string"), doc_id, text, item_id, item_text, keep, each_item=each_item)
    if len(frames) == 1:
        return frames[0].drop("__text")
    merged = _merged(frames, [*names, "__text"]).drop("__text")
    return merged if each_item else merged.withColumn("matches", _outermost(F.col("matches")))


def _outermost(matches: Column) -> Column:
    """What :func:`outermost` keeps, of matches of several blocks."""
    by_place = F.array_sort(matches, lambda x, y: F.coalesce(F.nullif(x["doc_start"] - y["doc_start"], F.lit(0)), F.nullif(y["n_words"] - x["n_words"], F.lit(0)), F.when(x["item"] < y["item"], -1).when(x["item"] > y["item"], 1).otherwise(0)))
    end = lambda x: x["doc_start"] + x["n_words"]
    return F.aggregate(by_place, F.array().cast(MATCHES), lambda out, x: F.when((F.size(out) == 0) | (end(F.element_at(out, -1)) < end(x)), F.concat(out, F.array(x))).otherwise(out))


def _merged(frames: list[DataFrame], names: list[str]) -> DataFrame:
    """One row from each document's rows, one for each block. Rows that agree in ``names`` are the same document (repeated rows give as many rows as one block has)."""
    tagged = [f.withColumn("__block", F.lit(i)) for i, f in enumerate(frames)]
    every = tagged[0]
    for f in tagged[1:]:
        every = every.unionByName(f)
    group = every.groupBy(*names, "n_words").agg(F.flatten(F.collect_set("hits")).alias("hits"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"), F.flatten(F.collect_set("matches")).alias("matches"), F.count(F.when(F.col("__block") == 0, 1)).alias("__times"))
    ordered = F.array_sort("hits")
    joined = F.aggregate(ordered, F.array().cast("array<struct<start:int,end:int>>"), lambda out, x: F.when((F.size(out) > 0) & (F.element_at(out, -1)["end"] >= x["start"]), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(F.element_at(out, -1)["start"].alias("start"), F.greatest(F.element_at(out, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(out, F.array(x))))
    return group.withColumn("hits", joined).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times")))).drop("__times", "__copy")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the documents that hold a window of the benchmark. Each block filters what the ones before left."""
    schema = docs.schema
    for rows in blocks(benchmark, item_id, item_text, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(rows)

        def run(batches, sent=sent):
            index = make_index(sent.value)
            for batch in sized(batches, text):
                runs = match_shard(batch.column(batch.schema.get_field_index(text)), index, "none")[1]
                yield batch.filter(pa.array([not r for r in runs], pa.bool_()))

        docs = arrow_map(docs, run, schema)
    return docs


def digest(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """What ``find`` gives, as counts and the SHA-256 of the items."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select(doc_id, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
