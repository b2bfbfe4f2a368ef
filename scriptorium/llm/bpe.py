"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file (operator 7).

The rank file is read once on the driver and broadcast; its size is checked. Texts longer than
``LONG`` code points are cut before a space or line feed that follows a non-space. No match of a
pattern such as ``public_tokenizers.PATTERN`` holds a non-space followed by white space, so every
such cut falls between two matches, and the pieces have the ids of the whole.

Cases: a null or empty text has no ids and decodes to no bytes. A text of any length is encoded
whole. Rows may repeat; every other column is passed through, but a column with the output's name
is replaced. Ids outside the vocabulary decode to null.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from scriptorium.llm.support import arrow_map, list_array, sized

#: Code points from which a text is cut, and about as many in each piece.
LONG = 20_000
#: A rank file larger than this isn't broadcast.
MAX_RANK_BYTES = 64 << 20
#: White-space runs beyond this are encoded without the pattern, whose engine keeps a state for each of them.
LONG_RUN = 50_000

_CUT = re.compile(r"(?<=\S)(?=[ \n])")
_RUN = re.compile(r"\s{%d,}" % LONG_RUN)
#: White space to Python but not to the pattern.
_NOT_SPACE = re.compile("[\x1c-\x1f]")
_encodings: dict[int, object] = {}


class Ranks:
    """A broadcast rank file and the pattern that goes with it."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        with open(path, "rb") as file:
            content = file.read(MAX_RANK_BYTES + 1)
        if len(content) > MAX_RANK_BYTES:
            raise ValueError(f"{path} has more than {MAX_RANK_BYTES} bytes")
        self.content, self.pattern, self.key = spark.sparkContext.broadcast(content), pattern, hash((content, pattern))

    def encoding(self):
        """The tiktoken encoding, made once in each Python worker."""
        if self.key not in _encodings:
            _encodings[self.key] = make_encoding(self.content.value, self.pattern)
        return _encodings[self.key]


def make_encoding(content: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}
    return tiktoken.Encoding("local_ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, length: int = LONG) -> Iterator[str]:
    """``text`` cut at safe boundaries into pieces of about ``length`` code points; a piece is longer if it has no boundary."""
    start = 0
    while len(text) - start > length:
        cut = _CUT.search(text, start + length)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(encoding, text: str) -> list[int]:
    """The ids of the whole text."""
    if len(text) <= LONG:
        return encoding.encode_ordinary(text)
    out: list[int] = []
    for piece in pieces(text):
        out += encode_piece(encoding, piece)
    return out


def encode_piece(encoding, piece: str) -> list[int]:
    """One piece. Of a long run of white space before a non-space, the pattern takes all but the last as one match; of one at the end, all."""
    run = _RUN.search(piece) if len(piece) > LONG_RUN else None
    if run is None or _NOT_SPACE.search(run[0]):
        return encoding.encode_ordinary(piece)
    end = run.end() if run.end() == len(piece) else run.end() - 1
    whole = piece[run.start() : end]
    return encoding.encode_ordinary(piece[: run.start()]) + encoding._encode_single_piece(whole) + encode_piece(encoding, piece[end:])


def _appended(batch: pa.RecordBatch, drop: list[str], name: str, column: pa.Array) -> pa.RecordBatch:
    keep = [i for i, n in enumerate(batch.schema.names) if n not in {*drop, name}]
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), column], names=[*(batch.schema.names[i] for i in keep), name])


def _schema(df: DataFrame, drop: list[str], name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name not in {*drop, name}] + [T.StructField(name, kind)])


def encode(df: DataFrame, ranks: Ranks, text: str = "text", out: str = "ids", drop: tuple[str, ...] = (), decoded: str | None = None) -> DataFrame:
    """``df`` and the ids of ``text`` in ``out``, without the columns in ``drop``. With ``decoded``, also the bytes that those ids decode to, which spares a second pass through Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = ranks.encoding()
        for batch in sized(batches, text):
            found = [np.array(encode_text(encoding, t or ""), dtype=np.int32) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            ids = list_array(np.concatenate([*found, np.zeros(0, np.int32)]), np.array([len(x) for x in found]), pa.int32())
            made = _appended(batch, [*drop], out, ids)
            if decoded:
                made = _appended(made, [], decoded, pa.array([encoding.decode_bytes(x.tolist()) for x in found], type=pa.binary()))
            yield made

    schema = _schema(df, [*drop], out, T.ArrayType(T.IntegerType()))
    if decoded:
        schema = T.StructType([f for f in schema.fields if f.name != decoded] + [T.StructField(decoded, T.BinaryType())])
    return arrow_map(df, run, schema)


def decode(df: DataFrame, ranks: Ranks, ids: str = "ids", out: str = "decoded", drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` and the bytes of ``ids`` in ``out``; the bytes need not be UTF-8. Null or unknown ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = ranks.encoding()

        def of(row: list[int] | None) -> bytes | None:
            try:
                return None if row is None else encoding.decode_bytes(row)
            except (KeyError, TypeError, OverflowError):
                return None

        for batch in batches:
            # A few rows at a time, as ids of long documents are large in Python.
            column = batch.column(batch.schema.get_field_index(ids))
            made = [of(row.as_py()) for row in column]
            yield _appended(batch, [*drop], out, pa.array(made, type=pa.binary()))

    return arrow_map(df, run, _schema(df, [*drop], out, T.BinaryType()))
