"""Suffix-array dedup (operator 5): bytes covered by long strings that an earlier document holds too.

Exact copies are settled by content address: the first of them stands for all. The other texts are
written once to a table dealt into parts by their hash. Then:

1. Every ``length``-byte window is named by the smallest hash of its ``ANCHOR``-byte strings, so equal
   windows have equal names wherever they are, and windows next to each other mostly share one and
   form a segment. Each part sends the names it holds, once each, packed by name range.
2. Names that a single document holds go. Each part cuts the segments of the others and sends each
   distinct one once, with the smallest id that holds it there.
3. For a range of names, the distinct segments meet. A segment without a window that another one
   holds too (by its hash) is settled; all others are dealt to shards, whose Burrows-Wheeler
   transforms are merged (``bwt``). The intervals with a common prefix of ``length`` or more give the
   smallest id of every window.
4. The answers return to the parts, which mark the covered bytes and hash what is left.

A name with more than ``CROWD`` segments, such as a long run of dashes, could outgrow a task. Its
windows are not gathered: each is a row with a 128-bit hash of its own, and Spark's aggregation
finds the smallest id, whatever the number of rows.

Parts and ranges are bounded by the number that is chosen from the input's size, and a name or
segment that many documents share counts once for each part.

Cases: null and empty texts, and those shorter than ``length``, lose nothing. Repeated rows (id and
text) are alike; rows that share an id don't count against each other. A row with a null id neither
loses bytes nor takes any. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import bwt
from scriptorium.llm.support import arrow_map, deleted_at_exit, discard, free_shuffles, release_memory, shared_folder, written

LENGTH, ANCHOR = 50, 20
PART_BYTES, RANGE_BYTES = 8 << 20, 1 << 20
#: Segments of one name (counted in each part to a power of two) beyond which its windows are resolved one by one.
CROWD = 1 << 16
#: Bytes that are hashed at a time, so that a core's cache holds the arrays.
PIECE = 1 << 17
#: Of a sum of text sizes, at most so many texts can hold a share of one in so many rows; they can be broadcast.
HEAVY, HEAVY_SPANS = 1000, 10_000
#: Buckets of the table of parts, and bytes of packed rows for each task that gathers a range.
MAX_BUCKETS, TASK_BYTES = 50_000, 64 << 20

_NONE = np.iinfo(np.int64).max
#: The lowest bits of a name carry a flag and the logarithm of a count.
_LOW = np.uint64(31)


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


class Rolling:
    """Polynomial hashes of any stretch of bytes, modulo 2**64, from running sums over random numbers for the byte values."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(0, 1 << 63, 256, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
        self.base = int(rng.integers(0, 1 << 61)) * 8 + 5
        self.up = self.down = np.ones(0, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, PIECE + 4096)
            for name, base in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                steps = np.full(n, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def sums(self, raw: np.ndarray) -> np.ndarray:
        self._powers(len(raw) + 1)
        out = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.values[raw] * self.up[: len(raw)], out=out[1:])
        return out

    def every(self, sums: np.ndarray, size: int) -> np.ndarray:
        """The hash of the ``size`` bytes from each place on."""
        n = max(len(sums) - size, 0)
        return (sums[size : size + n] - sums[:n]) * self.down[:n]

    def of(self, sums: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return (sums[starts + sizes] - sums[starts]) * self.down[starts]


_rolling: list[Rolling] = []


def rolling() -> list[Rolling]:
    """Two independent hashes, made once in a process."""
    if not _rolling:
        _rolling.extend((Rolling(1), Rolling(2)))
    return _rolling


def _names(sums: np.ndarray, length: int, anchor: int) -> np.ndarray:
    """The name of each window by its start, as if all bytes were one document."""
    least = _mixed(rolling()[0].every(sums, anchor))
    reach, step = length - anchor + 1, 1
    while step * 2 <= reach:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    left = reach - step
    return np.minimum(least[:-left], least[left:]) if left else least


@dataclass
class Segments:
    """Runs of windows of one text with one name: name, text, start in the joined bytes, size, and a number for the bytes' two hashes if asked."""

    names: np.ndarray
    texts: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    hashes: np.ndarray

    def take(self, at: np.ndarray) -> Segments:
        return Segments(self.names[at], self.texts[at], self.starts[at], self.sizes[at], self.hashes[at])


def segments(raw: np.ndarray, ends: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR, hashed: bool = False) -> Segments:
    """Of joined texts that end at ``ends``: their segments in order. One that crosses a piece is cut in two; each window is in one of them."""
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    out = []
    for base in range(0, len(raw) - length + 1, PIECE):
        block = raw[base : base + PIECE + length - 1]
        sums = [r.sums(block) for r in rolling()[: 2 if hashed else 1]]
        name = _names(sums[0], length, anchor)
        n = len(name)
        fresh = np.ones(n, bool)
        np.not_equal(name[1:], name[:-1], out=fresh[1:])
        lo, hi = np.searchsorted(ends, base, side="right"), np.searchsorted(ends, base + n + length, side="left") + 1
        # No window begins in the last length - 1 places of a text.
        stop, start = ends[lo:hi] - base, begins[lo:hi] - base
        last = np.maximum(stop - length + 1, start)
        for edge in (start, last):
            fresh[edge[(edge > 0) & (edge < n)]] = True
        gone = np.zeros(n + 1, np.int32)
        np.add.at(gone, np.clip(last, 0, n), 1)
        np.add.at(gone, np.clip(stop, 0, n), -1)
        run = np.flatnonzero(fresh)
        windows = np.diff(np.append(run, n))
        kept = np.cumsum(gone)[run] == 0
        run, sizes = run[kept], windows[kept] + length - 1
        hashes = np.stack([r.of(s, run, sizes) for r, s in zip(rolling(), sums, strict=True)], axis=1) if hashed else np.zeros((len(run), 0), np.uint64)
        # Minima are small numbers; mixed again, they are spread evenly over the ranges.
        out.append((_mixed(name[run]) | _LOW, np.searchsorted(ends, run + base, side="right"), run + base, sizes, hashes))
    if not out:
        none = np.zeros(0, np.int64)
        return Segments(np.zeros(0, np.uint64), none, none, none, np.zeros((0, 2 if hashed else 0), np.uint64))
    return Segments(*(np.concatenate(x) for x in zip(*out, strict=True)))


def numbered(names: np.ndarray, hashes: np.ndarray, sizes: np.ndarray, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each distinct segment (equal ones get equal numbers), and where each number occurs first.

    Bytes are told apart by two 64-bit hashes; those of long segments, which periodic texts may hold, by a cryptographic one."""
    hashes = hashes.copy()
    for i in np.flatnonzero(sizes > 4 * LENGTH).tolist():
        digest = hashlib.blake2b(raw[starts[i] : starts[i] + sizes[i]], digest_size=16).digest()
        hashes[i] = np.frombuffer(digest, dtype=np.uint64)
    order = np.lexsort((sizes, hashes[:, 1], hashes[:, 0], names))
    columns = (names[order], hashes[order, 0], hashes[order, 1], sizes[order])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, order[new]  # lexsort is stable, so the first of equal ones comes first


def joined(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each ends."""
    array = column.cast(pa.large_binary()).combine_chunks()
    array = pa.concat_arrays(array.chunks) if isinstance(array, pa.ChunkedArray) else array
    _, offsets, data = array.buffers()
    if data is None or not len(array):
        return np.zeros(0, np.uint8), np.zeros(len(array), np.int64)
    where = np.frombuffer(offsets, dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    return np.frombuffer(data, dtype=np.uint8)[where[0] : where[-1]], where[1:] - where[0]


def taken(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of the given ranges, one after the other."""
    if not len(starts):
        return np.zeros(0, np.uint8)
    return raw[_spread(starts, sizes)]


def by_range(names: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each name: equal slices of the 64-bit numbers."""
    return ((names >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def minima_of_range(names: np.ndarray, data: np.ndarray, sizes: np.ndarray, ids: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the segments of one range: number of runs of each, and joined, each run's number of windows and the smallest id that holds them."""
    starts, windows = np.cumsum(sizes) - sizes, sizes - length + 1
    hashes, seen = _hashed(data, starts, sizes, length)
    key, first = numbered(names, hashes, sizes, data, starts)
    n = len(first)
    least = np.full(n, _NONE)
    np.minimum.at(least, key, ids)
    own, size = names[first], sizes[first]
    _, group, count = np.unique(own, return_inverse=True, return_counts=True)
    contested = np.flatnonzero(count[group] > 1) if n else np.zeros(0, np.int64)
    # Only segments with a window that occurs twice can learn anything from the others; equal windows have equal hashes.
    seen = seen[_spread((np.cumsum(windows) - windows)[first[contested]], windows[first[contested]])]
    order = np.argsort(seen).astype(np.int32)
    seen = seen[order]
    twice = np.zeros(len(order) + 1, bool)
    twice[1:-1] = seen[1:] == seen[:-1]
    touched = np.zeros(len(contested), bool)
    touched[np.repeat(np.arange(len(contested), dtype=np.int32), windows[first[contested]])[order[twice[1:] | twice[:-1]]]] = True
    del seen, order, twice, hashes
    contested = contested[touched]
    # One name's segments only meet each other, and equal windows have one name, so one merge serves all names of the range.
    text = taken(data, starts[first[contested]], size[contested])
    worth = bwt.interval_minima(text, size[contested], least[contested], length)
    n_runs = np.ones(n, np.int64)
    place, owner = _window_places(size[contested], length)
    found = worth[place]
    cut = np.flatnonzero(np.concatenate([[True], (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])])) if len(found) else np.zeros(0, np.int64)
    n_runs[contested] = np.bincount(owner[cut], minlength=len(contested)) if len(contested) else 0
    # Runs of all distinct segments in order.
    begin = np.cumsum(n_runs) - n_runs
    flat_windows, flat_ids = np.empty(int(n_runs.sum()), np.int64), np.empty(int(n_runs.sum()), np.int64)
    settled = np.ones(n, bool)
    settled[contested] = False
    flat_windows[begin[settled]], flat_ids[begin[settled]] = (size - length + 1)[settled], least[settled]
    spread = _spread(begin[contested], n_runs[contested])
    flat_windows[spread], flat_ids[spread] = np.diff(np.append(cut, len(found))), found[cut]
    # And of all segments as they came.
    pick = _spread(begin[key], n_runs[key])
    return n_runs[key], flat_windows[pick], flat_ids[pick]


def _hashed(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each segment, and one of each of their windows, joined; a few segments at a time."""
    hashes, seen, lo = np.empty((len(sizes), 2), np.uint64), [np.zeros(0, np.uint64)], 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + PIECE, side="right")) - 1)
        base = starts[lo]
        sums = [r.sums(data[base : starts[hi - 1] + sizes[hi - 1]]) for r in rolling()]
        for i, (r, x) in enumerate(zip(rolling(), sums, strict=True)):
            hashes[lo:hi, i] = r.of(x, starts[lo:hi] - base, sizes[lo:hi])
        seen.append(rolling()[0].every(sums[0], length)[_window_places(sizes[lo:hi], length)[0]])
        lo = hi
    return hashes, np.concatenate(seen)


def _spread(begin: np.ndarray, times: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... for each, so many times."""
    return np.repeat(begin - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))


def window_hashes(raw: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Two hashes of the window from each start on, side by side."""
    out = np.zeros((len(starts), 2), np.uint64)
    for i, r in enumerate(rolling()):
        for k in range(length):
            out[:, i] = out[:, i] * np.uint64(r.base) + r.values[raw[starts + k]]
        _mixed(out[:, i])
    return out


def _window_places(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    windows = sizes - length + 1
    return _spread(np.cumsum(sizes) - sizes, windows), np.repeat(np.arange(len(sizes)), windows)


def covered(starts: np.ndarray, ends: np.ndarray, size: int) -> tuple[list[int], list[int]]:
    """Maximal runs of the union of ranges of one text (touching ones are one run)."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    return s[new].tolist(), e[np.append(np.flatnonzero(new)[1:] - 1, len(e) - 1)].tolist()


NAMES = "range int, part int, names binary, crowded int"
SEGMENTS = "range int, part int, names binary, sizes binary, ids binary, data binary"
ANSWERS = "part int, range int, runs binary, windows binary, ids binary"
#: Windows of crowded names travel as segments of this range: their hashes in ``names`` and their ids.
CROWDED = -1


def _table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    """The rows of a group, which is the last thing that its function makes."""
    release_memory()
    return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})


def _split(order_key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(value, places) for each value of ``order_key``."""
    order = np.argsort(order_key, kind="stable")
    values, first = np.unique(order_key[order], return_index=True)
    for v, a, b in zip(values.tolist(), first, np.append(first[1:], len(order)), strict=True):
        yield v, order[a:b]


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) for each row of ``docs``; spans: array of (start, end) in bytes, maximal runs."""
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    slim = written(source.select("id", "sha", F.octet_length("text").cast("long").alias("n_bytes")), "slim")
    firsts = slim.filter((F.col("n_bytes") >= length) & F.col("id").isNotNull()).groupBy("sha").agg(F.min("id").alias("first"), F.first("n_bytes").alias("n_bytes"), F.count("*").alias("rows"))
    firsts = written(firsts, "firsts")
    totals = firsts.agg(F.sum("n_bytes").alias("bytes"), F.sum("rows").alias("rows")).first()
    total = totals["bytes"] or 0
    parts, ranges = max(1, math.ceil(total / PART_BYTES)), max(1, math.ceil(total / RANGE_BYTES))
    buckets = min(max(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))), MAX_BUCKETS)
    part = F.pmod(F.xxhash64("sha"), F.lit(parts)).cast("int")
    name = f"scriptorium_parts_{uuid.uuid4().hex[:12]}"
    usable = source.filter((F.octet_length("text") >= length) & F.col("id").isNotNull()).select("id", "sha", F.col("text").cast("binary").alias("text"), part.alias("part"))
    # Copies share a part. A task sends one of those it sees, and a part keeps the one with the smallest id, so no join has to move the texts.
    where = deleted_at_exit(spark, f"{shared_folder(spark)}/{name}")
    arrow_map(usable, _one_of_each, usable.schema).repartition(buckets, "part").write.option("path", where).option("compression", "zstd").bucketBy(buckets, "part").saveAsTable(name)
    free_shuffles(spark)
    try:
        lost = _resolved(spark, name, ranges, max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / TASK_BYTES)), length)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    deleted_at_exit(spark, where, now=True)
    # Texts that a share of 1 / HEAVY of all rows hold are HEAVY at most, so they meet their rows by broadcast; the others by a shuffle without a hot key.
    known = firsts.select("sha", "first", "rows").join(lost, "sha", "left")
    heavy = (F.col("rows") > 1) & (F.col("rows") * HEAVY >= (totals["rows"] or 0)) & (F.coalesce(F.size("spans"), F.lit(0)) <= HEAVY_SPANS)
    known = written(known.withColumn("heavy", heavy), "known")
    few = F.broadcast(known.filter("heavy").drop("heavy"))
    warm = slim.join(few, "sha")
    cold = slim.join(F.broadcast(known.filter("heavy").select("sha")), "sha", "left_anti").join(known.filter("not heavy").drop("heavy"), "sha", "left")
    copy = F.col("first").isNotNull() & (F.col("id") > F.col("first"))
    hit = F.coalesce(F.col("n_removed") > 0, F.lit(False)) & F.col("id").isNotNull()
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_bytes").cast("int").alias("end")))
    none = F.array().cast("array<struct<start:int,end:int>>")
    return warm.unionByName(cold).select(
        F.col("id").alias(doc_id), "n_bytes",
        F.when(copy, F.col("n_bytes")).when(hit, F.col("n_removed")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(copy, F.lit(1)).when(hit, F.size("spans")).otherwise(F.lit(0)).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).when(hit, F.col("kept_sha256")).otherwise(F.col("sha")).alias("kept_sha256"),
        F.when(copy, whole).when(hit, F.col("spans")).otherwise(none).alias("spans"),
    )


def _smallest(rows: pa.Table | pa.RecordBatch) -> np.ndarray:
    """Of each text, the place of the row with the smallest id."""
    ids, sha = rows["id"].to_numpy(), np.array(rows["sha"].to_pylist(), dtype="S64")
    order = np.lexsort((ids, sha))
    return np.sort(order[np.concatenate([np.ones(min(1, len(order)), bool), sha[order][1:] != sha[order][:-1]])])


def _one_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches without rows whose text the task has sent before under the same or a smaller id."""
    sent: dict[bytes, int] = {}
    for batch in batches:
        batch = batch.take(pa.array(_smallest(batch)))
        keep = [sent.get(s, i + 1) > i for s, i in zip(batch["sha"].to_pylist(), batch["id"].to_pylist(), strict=True)]
        sent.update(x for x, k in zip(zip(batch["sha"].to_pylist(), batch["id"].to_pylist(), strict=True), keep, strict=True) if k)
        yield batch.filter(pa.array(keep, pa.bool_()))


def _firsts(group: pa.Table) -> pa.Table:
    """A part with one row for each text."""
    at = _smallest(group)
    return group if len(at) == len(group) else group.take(pa.array(at))


def _name_rows(key: tuple, group: pa.Table, length: int, ranges: int) -> pa.Table:
    """Of one part: its distinct names by range. The low bits tell whether two documents of the part hold the name, and about how many segments have it."""
    found = segments(*joined(_firsts(group)["text"]), length)
    order = np.lexsort((found.texts, found.names))
    names, texts = found.names[order], found.texts[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(names)), bool), names[1:] != names[:-1]]))
    last = np.append(first[1:], len(names)) - 1 if len(first) else first
    several = texts[first] != texts[last]
    often = np.minimum(np.ceil(np.log2(np.maximum(last - first + 1, 1))), 15).astype(np.uint64)
    sent = (names[first] & ~_LOW) | often << np.uint64(1) | several.astype(np.uint64)
    rows = [(r, key[0].as_py(), sent[at].tobytes(), 0) for r, at in _split(by_range(sent, ranges))]
    return _table(rows, ["range", "part", "names", "crowded"], [pa.int32(), pa.int32(), pa.binary(), pa.int32()])


def _shared_rows(key: tuple, group: pa.Table, crowd: int) -> pa.Table:
    """Of one range: for each part, which of its names other documents hold too; the lowest bit marks those with more than ``crowd`` segments."""
    names = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in group["names"]]
    every = np.concatenate([*names, np.zeros(0, np.uint64)])
    distinct, inverse, count = np.unique(every & ~_LOW, return_inverse=True, return_counts=True)
    several = np.zeros(len(distinct), bool)
    several[inverse[(every & np.uint64(1)) > 0]] = True
    crowded = np.bincount(inverse, weights=2.0 ** ((every & _LOW) >> np.uint64(1)), minlength=len(distinct)) > crowd
    keep = ((count > 1) | several)[inverse]
    told = (every & ~_LOW) | crowded[inverse]
    ends = np.cumsum([len(x) for x in names])
    rows = []
    for i, (end, x) in enumerate(zip(ends, names, strict=True)):
        own = told[end - len(x) : end][keep[end - len(x) : end]]
        rows.append((key[0].as_py(), group["part"][i].as_py(), own.tobytes(), int((own & np.uint64(1)).sum())))
    return _table(rows, ["range", "part", "names", "crowded"], [pa.int32(), pa.int32(), pa.binary(), pa.int32()])


@dataclass
class Part:
    """What a part holds of shared names: its distinct segments of ordinary names, and its windows of crowded ones."""

    raw: np.ndarray
    ends: np.ndarray
    found: Segments
    number: np.ndarray
    first: np.ndarray
    window_text: np.ndarray
    window_start: np.ndarray
    window_hash: np.ndarray


def _part(text: pa.Table, known: pa.Table, length: int) -> Part:
    raw, ends = joined(text["text"])
    every = segments(raw, ends, length, hashed=True)
    wanted = np.unique(np.concatenate([*(np.frombuffer(x.as_py(), dtype=np.uint64) for x in known["names"]), np.zeros(0, np.uint64)]))
    plain = every.names & ~_LOW
    place = np.minimum(np.searchsorted(wanted, plain), len(wanted) - 1)
    shared = (wanted[place] & ~_LOW == plain) if len(wanted) else np.zeros(len(plain), bool)
    crowded = shared & (wanted[place] & np.uint64(1) > 0) if len(wanted) else shared
    found = every.take(np.flatnonzero(shared & ~crowded))
    number, first = numbered(found.names, found.hashes, found.sizes, raw, found.starts)
    crowd = every.take(np.flatnonzero(crowded))
    windows = crowd.sizes - length + 1
    start = _spread(crowd.starts, windows)
    return Part(raw, ends, found, number, first, np.repeat(crowd.texts, windows), start, window_hashes(raw, start, length))


def _segment_rows(key: tuple, text: pa.Table, known: pa.Table, length: int, ranges: int) -> pa.Table:
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
    columns = ["range", "part", "names", "sizes", "ids", "data"]
    if not len(text):
        return _table([], columns, kinds)
    text = _firsts(text)
    p = _part(text, known, length)
    ids = text["id"].to_numpy()
    least = np.full(len(p.first), _NONE)
    np.minimum.at(least, p.number, ids[p.found.texts])
    one = p.found.take(p.first)
    rows = []
    for r, at in _split(by_range(one.names, ranges)):
        rows.append((r, key[0].as_py(), one.names[at].tobytes(), one.sizes[at].astype(np.int32).tobytes(), least[at].tobytes(), taken(p.raw, one.starts[at], one.sizes[at]).tobytes()))
    if len(p.window_start):
        order = np.lexsort((ids[p.window_text], p.window_hash[:, 1], p.window_hash[:, 0]))
        hashes = p.window_hash[order]
        new = np.concatenate([[True], (hashes[1:] != hashes[:-1]).any(axis=1)])
        rows.append((CROWDED, key[0].as_py(), hashes[new].tobytes(), b"", ids[p.window_text][order][new].tobytes(), b""))
    return _table(rows, columns, kinds)


def _answer_rows(key: tuple, group: pa.Table, length: int) -> pa.Table:
    unpack = lambda c, kind: [np.frombuffer(x.as_py(), dtype=kind) for x in group[c]]
    names, sizes, ids, data = unpack("names", np.uint64), unpack("sizes", np.int32), unpack("ids", np.int64), unpack("data", np.uint8)
    counts = [len(x) for x in names]
    n_runs, windows, least = minima_of_range(np.concatenate(names), np.concatenate(data), np.concatenate(sizes).astype(np.int64), np.concatenate(ids), length)
    rows, run_ends, at = [], np.concatenate([[0], np.cumsum(n_runs)]), 0
    for i, c in enumerate(counts):
        a, b = run_ends[at], run_ends[at + c]
        rows.append((group["part"][i].as_py(), key[0].as_py(), n_runs[at : at + c].astype(np.int32).tobytes(), windows[a:b].astype(np.int32).tobytes(), least[a:b].tobytes()))
        at += c
    return _table(rows, ["part", "range", "runs", "windows", "ids"], [pa.int32(), pa.int32(), *[pa.binary()] * 3])


def _crowd_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed windows as rows."""
    for batch in batches:
        for part, hashes, ids in zip(batch["part"].to_pylist(), batch["names"], batch["ids"], strict=True):
            pairs = np.frombuffer(hashes.as_py(), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), part, np.int32)), pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()), pa.array(np.frombuffer(ids.as_py(), dtype=np.int64))], names=["part", "h1", "h2", "least"])


def _removed_rows(key: tuple, text: pa.Table, known: pa.Table, length: int, ranges: int) -> pa.Table:
    """Of one part: the ranges that each of its texts loses, and the hash of what is left."""
    columns = ["sha", "n_removed", "kept_sha256", "start", "end"]
    out: list[tuple] = []
    if len(text) and len(known):
        text = _firsts(text)
        p = _part(text, known.filter(known["names"].is_valid()), length)
        told = {row["range"]: row for row in known.select(["range", "runs", "windows", "ids"]).filter(known["runs"].is_valid()).to_pylist()}
        n = len(p.first)
        n_runs, begin = np.zeros(n, np.int64), np.zeros(n, np.int64)
        windows, least, base = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for r, at in _split(by_range(p.found.names[p.first], ranges)):
            runs = np.frombuffer(told[r]["runs"], dtype=np.int32).astype(np.int64)
            n_runs[at], begin[at] = runs, base + np.cumsum(runs) - runs
            windows.append(np.frombuffer(told[r]["windows"], dtype=np.int32).astype(np.int64))
            least.append(np.frombuffer(told[r]["ids"], dtype=np.int64))
            base += int(runs.sum())
        windows, least = np.concatenate(windows), np.concatenate(least)
        before = np.cumsum(windows) - windows  # within all runs; made relative to the segment below
        times = n_runs[p.number]
        run, owner = _spread(begin[p.number], times), np.repeat(np.arange(len(p.number)), times)
        offset = before[run] - before[begin[p.number]][owner] if len(run) else run
        ids = text["id"].to_numpy()
        hit = least[run] < ids[p.found.texts[owner]]
        owner, offset, run = owner[hit], offset[hit], run[hit]
        lo = p.found.starts[owner] + offset
        hi, of = lo + windows[run] + length - 1, p.found.texts[owner]
        if len(p.window_start):
            crowd = known.filter(known["h1"].is_valid())
            pairs = np.stack([crowd[c].to_numpy() for c in ("h1", "h2")], axis=1).view(np.uint64)
            every = np.concatenate([pairs, p.window_hash])
            best = np.concatenate([crowd["least"].to_numpy(), np.full(len(p.window_hash), _NONE)])
            order = np.lexsort((best, every[:, 1], every[:, 0]))
            group = np.cumsum(np.concatenate([[True], (every[order][1:] != every[order][:-1]).any(axis=1)])) - 1
            smallest = np.empty(len(every), np.int64)
            smallest[order] = best[order][np.searchsorted(group, np.arange(group[-1] + 1))][group]
            at = np.flatnonzero(smallest[len(pairs) :] < ids[p.window_text])
            lo, hi, of = np.concatenate([lo, p.window_start[at]]), np.concatenate([hi, p.window_start[at] + length]), np.concatenate([of, p.window_text[at]])
        begins = np.concatenate([[0], p.ends[:-1]])
        for d, at in _split(of):
            s, e = covered(lo[at], hi[at], 0)
            kept, last = hashlib.sha256(), int(begins[d])
            for a, b in zip(s, e, strict=True):
                kept.update(p.raw[last:a])
                last = b
            kept.update(p.raw[last : int(p.ends[d])])
            base_ = int(begins[d])
            out.append((text["sha"][d].as_py(), sum(e) - sum(s), kept.hexdigest(), [x - base_ for x in s], [x - base_ for x in e]))
    return _table(out, columns, [pa.string(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())])


def _resolved(spark: SparkSession, name: str, ranges: int, tasks: int, length: int) -> DataFrame:
    """(sha, n_removed, kept_sha256, spans) of the texts in the table that lose bytes. tasks: how many gather ranges."""
    table, crowd = spark.table(name), CROWD

    def name_rows(key: tuple, group: pa.Table) -> pa.Table:
        return _name_rows(key, group, length, ranges)

    def shared_rows(key: tuple, group: pa.Table) -> pa.Table:
        return _shared_rows(key, group, crowd)

    def segment_rows(key: tuple, text: pa.Table, known: pa.Table) -> pa.Table:
        return _segment_rows(key, text, known, length, ranges)

    def answer_rows(key: tuple, group: pa.Table) -> pa.Table:
        return _answer_rows(key, group, length)

    def removed_rows(key: tuple, text: pa.Table, known: pa.Table) -> pa.Table:
        return _removed_rows(key, text, known, length, ranges)

    sent = table.groupBy("part").applyInArrow(name_rows, NAMES)
    shared = written(sent.repartition(tasks, "range").groupBy("range").applyInArrow(shared_rows, NAMES), "names")
    free_shuffles(spark)
    cut = written(table.groupBy("part").cogroup(shared.groupBy("part")).applyInArrow(segment_rows, SEGMENTS), "segments")
    answers = cut.filter(F.col("range") != CROWDED).repartition(tasks, "range").groupBy("range").applyInArrow(answer_rows, ANSWERS)
    both = shared.select("part", "range", "names").unionByName(answers, allowMissingColumns=True)
    if shared.filter("crowded > 0").limit(1).count():
        windows = arrow_map(cut.filter(F.col("range") == CROWDED).select("part", "names", "ids"), _crowd_rows, "part int, h1 long, h2 long, least long")
        windows = written(windows, "windows")
        # Minima are combined before the shuffle; the join streams the rows of a window that every part holds.
        best = windows.groupBy("h1", "h2").agg(F.min("least").alias("least"))
        both = both.unionByName(windows.drop("least").join(best, ["h1", "h2"]), allowMissingColumns=True)
    else:
        windows = None
        both = both.select("*", *(F.lit(None).cast("long").alias(c) for c in ("h1", "h2", "least")))
    found = table.groupBy("part").cogroup(both.groupBy("part")).applyInArrow(removed_rows, "sha string, n_removed long, kept_sha256 string, start array<int>, end array<int>")
    spans = F.arrays_zip(F.col("start"), F.col("end")).cast("array<struct<start:int,end:int>>")
    result = written(found.select("sha", "n_removed", "kept_sha256", spans.alias("spans")), "removed")
    discard(shared, cut, *([windows] if windows is not None else []))
    free_shuffles(spark)
    return result


def digest(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    return found.select(doc_id, "n_bytes", "n_removed", "n_spans", "kept_sha256")
