import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.sources import png


def _png(values, depth, colour, kinds):
    """A PNG written sample by sample, with any filter for each row, in plain Python."""
    import struct
    import zlib

    samples = png.SAMPLES[colour]
    step = max(1, samples * depth // 8)
    above, body = None, b""
    for row, kind in zip(values, kinds):
        flat = [v for pixel in row for v in pixel]
        if depth < 8:
            bits = "".join(f"{v:0{depth}b}" for v in flat)
            line = [int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8)]
        else:
            line = [b for v in flat for b in v.to_bytes(depth // 8, "big")]
        above = above or [0] * len(line)
        out = []
        for i, v in enumerate(line):
            a, b, c = (line[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
            p = a + b - c
            nearest = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out.append((v - (0, a, b, (a + b) // 2, nearest)[kind]) % 256)
        body += bytes([kind, *out])
        above = line
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    palette = chunk(b"PLTE", bytes(range(48))) if colour == 3 else b""
    head = struct.pack(">IIBBBBB", len(values[0]), len(values), depth, colour, 0, 0, 0)
    return png.SIGNATURE + chunk(b"IHDR", head) + palette + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


@pytest.mark.parametrize(("depth", "colour"), [(8, 0), (8, 2), (8, 4), (8, 6), (16, 2), (1, 0), (4, 3), (2, 0)])
def test_png_of_all_kinds(depth, colour):
    rng = np.random.default_rng(depth * 10 + colour)
    values = rng.integers(0, min(1 << depth, 1 << 16), (11, 9, png.SAMPLES[colour])).tolist()
    got = png.decode(_png(values, depth, colour, [0, 1, 2, 3, 4, 4, 3, 2, 1, 0, 4]))
    array = np.array(values)
    want = array >> 8 if depth == 16 else array * 255 // ((1 << depth) - 1) if depth < 8 and colour != 3 else array
    if colour == 3:
        assert got.tolist() == [[[3 * v + 2, 3 * v + 1, 3 * v] for (v,) in row] for row in values]
    else:
        assert (got == (want[..., 0] if png.SAMPLES[colour] < 3 else want[..., 2::-1])).all()


def test_png_round_trip_and_failures(spark, tmp_path):
    rng = np.random.default_rng(3)
    for shape in ((1, 1), (7, 5), (6, 4, 3)):
        image = rng.integers(0, 256, shape).astype(np.uint8)
        assert (png.decode(png.encode(image)) == image).all()
    good = png.encode(image)
    for bad in (b"", b"x" * 40, good[:30], good[:-20] + b"y" * 20, good[:40] + b"?" + good[41:]):
        with pytest.raises(OSError):
            png.decode(bad)
    with pytest.raises(ValueError):
        png.encode(np.zeros((0, 3), np.uint8))
    pages = spark.createDataFrame([("b", "1", bytearray(good)), ("b", "2", bytearray(b"junk")), ("b", "3", None)], "book_id string, page_id string, content binary")
    read = {r["page_id"]: r for r in png.decoded(pages).collect()}
    assert (read["1"]["height"], read["1"]["width"], read["1"]["channels"]) == (6, 4, 3) and read["2"]["error"].startswith("OSError") and read["3"]["error"]
    files = png.decoded(pages).withColumn("output_path", F.concat_ws("/", "book_id", F.concat("page_id", F.lit(".png"))))
    done = {r["path"]: r for r in png.written(files, f"file://{tmp_path}").collect()}
    assert done["b/1.png"]["error"] is None and done["b/2.png"]["error"]
    assert (png.decode((tmp_path / "b" / "1.png").read_bytes()) == image).all() and len(list((tmp_path / "b").iterdir())) == 1
