"""PNG images to arrays and back, with zlib and NumPy only (the format's published definition)."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Fixed values of the format: samples of a pixel by colour type.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    if data[:8] != SIGNATURE:
        raise OSError("not a PNG image")
    at = 8
    while at + 12 <= len(data):
        (size,) = struct.unpack(">I", data[at : at + 4])
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if len(body) < size or zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise OSError("a PNG chunk is damaged")
        yield kind, body
        at += 12 + size


def _unfiltered(lines: np.ndarray, kinds: np.ndarray, step: int) -> np.ndarray:
    """Undo the row filters. All rows go on together, each a pixel behind the row above, so that what a pixel refers to is there."""
    height, width = lines.shape
    columns = width // step
    out = np.zeros((height + 1, columns + 1, step), np.int16)
    raw = lines.reshape(height, columns, step)
    for d in range(height + columns - 1):
        y = np.arange(max(0, d - columns + 1), min(height, d + 1))
        x = d - y
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        guess = left + up - corner
        pa, pb, pc = abs(guess - left), abs(guess - up), abs(guess - corner)
        paeth = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, up, corner))
        added = np.select([kinds[y, None] == k for k in (1, 2, 3, 4)], [left, up, (left + up) // 2, paeth], 0)
        out[y + 1, x + 1] = (raw[y, x] + added) & 255
    return out[1:, 1:].reshape(height, width).astype(np.uint8)


def decode(data: bytes) -> np.ndarray:
    """uint8, height by width for grey images, else height by width by three (BGR). Alpha is left out, sixteen bits become eight. What can't be read is an OSError."""
    try:
        found: dict[bytes, bytes] = {}
        for kind, body in _chunks(data):
            found[kind] = found.get(kind, b"") + body
        width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", found[b"IHDR"])
        if interlaced:
            raise OSError("interlaced PNG images aren't read")
        samples = SAMPLES[colour]
        line = (width * samples * depth + 7) // 8
        flat = np.frombuffer(zlib.decompress(found[b"IDAT"]), np.uint8).reshape(height, line + 1)
        if flat[:, 0].max(initial=0) > 4:
            raise OSError("unknown row filter")
        lines = _unfiltered(flat[:, 1:], flat[:, 0], max(1, samples * depth // 8))
        if depth < 8:
            bits = np.unpackbits(lines, axis=1).reshape(height, -1, depth)
            values = (bits @ (1 << np.arange(depth)[::-1]))[:, :width, None].astype(np.uint8)
            if colour != 3:
                values = (values.astype(int) * 255 // ((1 << depth) - 1)).astype(np.uint8)
        else:
            values = lines.reshape(height, width, samples, depth // 8)[..., 0]
        if colour == 3:
            return np.frombuffer(found[b"PLTE"], np.uint8).reshape(-1, 3)[values[..., 0]][..., ::-1].copy()
        return values[..., 0].copy() if samples < 3 else values[..., 2::-1].copy()
    except (KeyError, ValueError, IndexError, struct.error, zlib.error) as broken:
        raise OSError(f"not a readable PNG image: {broken}") from broken


def encode(image: np.ndarray) -> bytes:
    """A grey or BGR image as eight-bit PNG; each row is the difference from the one above."""
    if image.dtype != np.uint8 or image.ndim not in (2, 3) or not image.size:
        raise ValueError("expected a filled uint8 image of two or three dimensions")
    rows = image if image.ndim == 2 else image[..., 2::-1]
    lines = np.ascontiguousarray(rows).reshape(image.shape[0], -1)
    above = np.concatenate([np.zeros((1, lines.shape[1]), np.uint8), lines[:-1]])
    body = np.concatenate([np.full((len(lines), 1), 2, np.uint8), lines - above], axis=1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 8, 0 if image.ndim == 2 else 2, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(body, 6)) + chunk(b"IEND", b"")


PIXELS = "height int, width int, channels int, pixels binary, error string"


def decoded(df: DataFrame, keys: tuple[str, ...] = ("book_id", "page_id"), content: str = "content") -> DataFrame:
    """(keys, height, width, channels, pixels, error): the images of ``content``, a page whose image can't be read with the error."""
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for *key, data in batch.itertuples(index=False, name=None):
                try:
                    image = decode(data or b"")
                    rows.append((*key, image.shape[0], image.shape[1], 1 if image.ndim == 2 else 3, image.tobytes(), None))
                except OSError as e:
                    rows.append((*key, None, None, None, None, f"OSError: {e}"))
            out = pd.DataFrame(rows, columns=[*keys, "height", "width", "channels", "pixels", "error"])
            yield out.astype({c: "Int32" for c in ("height", "width", "channels")})

    return df.select(*keys, content).mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + PIXELS)


def written(df: DataFrame, root: str, path: str = "output_path") -> DataFrame:
    """Write the images (``path`` below ``root``, height, width, channels, pixels) as PNG files and return (path, n_bytes, error).

    A file is written under a name of its own and then moved, so a task that runs twice leaves one whole file. Runs when the result is read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            rows = []
            for name, height, width, channels, pixels in batch.itertuples(index=False, name=None):
                try:
                    flat = np.frombuffer(pixels, np.uint8)
                    made = encode(flat.reshape(height, width) if channels == 1 else flat.reshape(height, width, channels))
                    target = f"{base}/{name}"
                    files.create_dir(target.rsplit("/", 1)[0], recursive=True)
                    with files.open_output_stream(own := f"{target}.{uuid.uuid4().hex}") as out:
                        out.write(made)
                    files.move(own, target)
                    rows.append((name, len(made), None))
                except (OSError, ValueError, TypeError) as e:
                    rows.append((name, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "n_bytes", "error"]).astype({"n_bytes": "Int64"})

    return df.select(path, "height", "width", "channels", "pixels").mapInPandas(run, "path string, n_bytes long, error string")
