"""Document fingerprints by one-permutation MinHash (operator 11).

Every shingle of ``SHINGLE`` words is hashed once. The hash's upper bits name one of ``BINS`` bins,
each of which keeps its least hash. An empty bin is filled by optimal densification: it takes the
value of the first bin that holds one in a pseudo-random order of its own, as if it drew bins by a
2-universal hash until one is filled. Of every bin ``BITS`` low-order bits are stored, packed. They
are taken after the value was mixed with the bin's number, so that copies of one value agree by
chance independently; :func:`likeness` corrects for that chance, which is 2 ** -BITS.

``edited`` needs each document's successor. Rows are dealt to ranges of (id, hash of the text, row),
sorted there, and run through once; only the last row of each range waits for the first one of the
next, and these few meet afterwards by the number of their range.

Cases: words are what ASCII white space parts, with A-Z in lower case; a text of fewer words than a
shingle has one shingle, and a text without words (null, empty, blank) an empty fingerprint, which is
like itself (1.0) and unlike all others (0.0). Texts of any length are taken whole. Ids may repeat or
be null: rows go by descending id, nulls last, then by a hash of their text, then by the text, so
repeated rows follow each other. A single row is its own successor; no rows give none. Only the
named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm.jaccard import _ODD, _mixed, shingle_hashes
from scriptorium.llm.support import arrow_map, sized, texts, written

SHINGLE, BINS, BITS = 5, 1024, 2
#: With fewer filled bins than this, all of them are compared for each empty one instead of drawing one after the other.
FEW = 32

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_orders: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def bin_orders(bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """For each bin the order in which it looks at the others, and the place of each other bin in that order."""
    if bins not in _orders:
        with np.errstate(over="ignore"):
            drawn = _mixed((np.arange(1, bins * bins + 1, dtype=np.uint64) * _ODD)).reshape(bins, bins)
        turn = np.argsort(drawn, axis=1, kind="stable").astype(np.uint16)
        place = np.empty_like(turn)
        np.put_along_axis(place, turn.astype(np.int64), np.arange(bins, dtype=np.uint16)[None, :].repeat(bins, axis=0), axis=1)
        _orders[bins] = turn, place
    return _orders[bins]


def densified(table: np.ndarray) -> np.ndarray:
    """``table`` (documents by bins) with every empty bin of a document that has a filled one filled from it."""
    turn, place = bin_orders(table.shape[1])
    held = table != _EMPTY
    n = held.sum(axis=1)
    out = table.copy()
    for d in np.flatnonzero((n > 0) & (n < FEW)):
        own, empty = np.flatnonzero(held[d]), np.flatnonzero(~held[d])
        out[d, empty] = table[d, own[np.argmin(place[empty][:, own], axis=1)]]
    docs, bins = np.nonzero(~held & (n >= FEW)[:, None])
    for t in range(table.shape[1]):
        if not len(docs):
            break
        source = turn[bins, t]
        hit = held[docs, source]
        out[docs[hit], bins[hit]] = table[docs[hit], source[hit]]
        docs, bins = docs[~hit], bins[~hit]
    return out


def packed(column: pa.Array, size: int = SHINGLE, bins: int = BINS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The packed bits of each text's fingerprint (a row of bytes each), and whether the text has a word."""
    hashes, counts = shingle_hashes(column, size)
    docs = np.repeat(np.arange(len(counts)), counts)
    table = np.full(len(counts) * bins, _EMPTY)
    np.minimum.at(table, docs * bins + (hashes >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64), hashes)
    values = densified(table.reshape(len(counts), bins))
    with np.errstate(over="ignore"):
        low = _mixed(values + np.arange(bins, dtype=np.uint64) * _ODD) & np.uint64((1 << bits) - 1)
    each = (low[:, :, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(each.astype(np.uint8).reshape(len(counts), bins * bits), axis=1), counts > 0


def likeness(a: np.ndarray, b: np.ndarray, some_a: np.ndarray, some_b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Estimated Jaccard similarity of rows of packed fingerprints, freed of the bits that agree by chance; within 0 and 1."""
    differ = np.unpackbits(a ^ b, axis=1).reshape(len(a), -1, bits).any(axis=2).mean(axis=1) if len(a) else np.zeros(0)
    by_chance = 2.0**-bits
    found = np.clip((1 - differ - by_chance) / (1 - by_chance), 0, 1)
    return np.where(some_a & some_b, found, (some_a == some_b).astype(float))


def _binary(rows: np.ndarray, some: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() if s else b"" for r, s in zip(rows, some, strict=True)], type=pa.binary())


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``df`` with the packed fingerprint of ``text`` in ``out``; a column of that name is replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches, text):
            column = _binary(*packed(batch.column(batch.schema.get_field_index(text))))
            keep = [i for i, n in enumerate(batch.schema.names) if n != out]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), column], names=[*(batch.schema.names[i] for i in keep), out])

    return arrow_map(df, run, T.StructType([f for f in df.schema.fields if f.name != out] + [T.StructField(out, T.BinaryType())]))


def alike(a: Column, b: Column, bits: int = BITS) -> Column:
    """:func:`likeness` of two fingerprint columns, for any plan."""

    @F.pandas_udf("double")
    def run(x, y):
        import pandas as pd

        width = max([len(v) for v in (*x, *y) if v] or [1])
        rows = lambda s: np.frombuffer(b"".join((v or b"").ljust(width, b"\0") for v in s), np.uint8).reshape(len(s), width)
        some = lambda s: np.array([bool(v) for v in s], bool)
        return pd.Series(likeness(rows(x), rows(y), some(x), some(y), bits))

    return run(a, b)


_FOUND = "n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
#: What a row is: a result, or the text at a range's first or last place.
RESULT, FIRST, LAST = 0, 1, 2


def _compared(own: list[str], following: list[str]) -> list[pa.Array]:
    """The columns of ``_FOUND`` of texts and what follows them."""
    edited = [t[: len(t) - len(t) // 3] + f[: len(t) // 3] for t, f in zip(own, following, strict=True)]
    # A text mostly follows the one before, so its fingerprint is made once.
    once = list(dict.fromkeys([*own, *following]))
    at = {t: i for i, t in enumerate(once)}
    rows, some = packed(pa.array(once, pa.large_string()))
    a, n = ([at[t] for t in side] for side in (own, following))
    other, has = packed(pa.array(edited, pa.large_string()))
    return [
        pa.array([len(t) for t in own], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
        _binary(rows[a], some[a]),
        _binary(other, has),
        pa.array(likeness(rows[a], other, some[a], has)),
        pa.array(likeness(rows[a], rows[n], some[a], some[n])),
    ]


def edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: its id, n_chars, the SHA-256 of its edited text, both fingerprints, and the likeness of its own to the edited one and to its successor's.

    The edited text has its last third replaced by as many characters of the successor's beginning; after the last row comes the first."""
    source = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = F.desc_nulls_last("id")
    dealt = source.withColumn("hash", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id()).repartitionByRange(order, "hash", "row")
    lined = dealt.sortWithinPartitions(order, "hash", "text").select("id", "text", F.spark_partition_id().alias("range"))
    kind = source.schema["id"].dataType.simpleString()
    schema = f"id {kind}, {_FOUND}, what int, range int, text string"
    names = ["id", *(part.split()[0] for part in _FOUND.split(", ")), "what", "range", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def place(what: int) -> pa.RecordBatch:
            none = pa.nulls(1)
            return pa.RecordBatch.from_arrays([ids, *([none.cast(k) for k in kinds]), pa.array([what], pa.int32()), number, pa.array([held], pa.string())], names=names)

        kinds = [pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
        held = ids = number = None
        for batch in sized(batches, "text"):
            own = texts(batch.column(1)).to_pylist()
            if held is None:
                held, ids, number = own[0], batch.column(0).slice(0, 1), batch.column(2).slice(0, 1)
                yield place(FIRST)
                before, before_ids = [], batch.column(0).slice(0, 0)
            else:
                before, before_ids = [held], ids
            line = [*before, *own]
            if len(line) > 1:
                every = pa.concat_arrays([before_ids, batch.column(0)])
                n = len(line) - 1
                yield pa.RecordBatch.from_arrays([every.slice(0, n), *_compared(line[:-1], line[1:]), pa.array([RESULT] * n, pa.int32()), pa.array([None] * n, pa.int32()), pa.nulls(n, pa.string())], names=names)
            held, ids = own[-1], batch.column(0).slice(len(batch) - 1, 1)
        if held is not None:
            yield place(LAST)

    found = written(arrow_map(lined, run, schema), "fingerprints")
    return found.filter(F.col("what") == RESULT).drop("what", "range", "text").unionByName(_closed(found, names[1:7])).withColumnRenamed("id", doc_id)


def _closed(found: DataFrame, columns: list[str]) -> DataFrame:
    """Results of the rows at the ranges' ends: a row for each range, so as many as there were tasks."""
    spark = found.sparkSession
    ranges = sorted(r["range"] for r in found.filter(F.col("what") == FIRST).select("range").collect())
    after = spark.createDataFrame([(r, ranges[(i + 1) % len(ranges)]) for i, r in enumerate(ranges)], "range int, after int")
    firsts = found.filter(F.col("what") == FIRST).select(F.col("range").alias("after"), F.col("text").alias("following"))
    lasts = found.filter(F.col("what") == LAST).select("id", "range", "text")
    pairs = lasts.join(after, "range").join(firsts, "after").select("id", "text", "following")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), *_compared(*(texts(batch.column(i)).to_pylist() for i in (1, 2)))], names=["id", *columns])

    return arrow_map(pairs, run, f"id {pairs.schema['id'].dataType.simpleString()}, {_FOUND}")


def digest(found: DataFrame) -> DataFrame:
    """What ``edited`` gives with both fingerprints as base64 text."""
    return found.withColumns({c: F.base64(c) for c in ("fingerprint", "edited_fingerprint")})
