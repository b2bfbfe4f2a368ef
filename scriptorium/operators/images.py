"""Image stages over arrays, and the fused pipeline that applies them to a table of images.

Arrays are uint8, height by width or height by width by three (BGR). All stages are NumPy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Stage = Callable[[np.ndarray], np.ndarray]


def _checked(image: np.ndarray) -> np.ndarray:
    if image.ndim not in (2, 3):
        raise ValueError(f"expected two or three dimensions, got {image.ndim}")
    return image


def gray(image: np.ndarray) -> np.ndarray:
    """Luma of a BGR image, rounded; a grey image as it is."""
    if _checked(image).ndim == 2:
        return image
    return np.rint(image[..., :3].astype(np.float64) @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)


def gaussian_mean(image: np.ndarray, size: int) -> np.ndarray:
    """Weighted mean of each pixel's surroundings; the border is repeated. Sigma follows from the size as usual: 0.3 ((size - 1) / 2 - 1) + 0.8."""
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    x = np.arange(size) - size // 2
    kernel = np.exp(-(x**2) / (2 * sigma**2))
    kernel /= kernel.sum()
    half = size // 2
    wide = np.pad(image.astype(np.float64), ((half, half), (half, half)), mode="edge")
    rows = sum(w * wide[:, k : k + image.shape[1]] for k, w in enumerate(kernel))
    return sum(w * rows[k : k + image.shape[0]] for k, w in enumerate(kernel))


def binarize(image: np.ndarray, block_size: int = 11, c: int = 2) -> np.ndarray:
    """White where a pixel exceeds its surroundings' weighted mean less ``c``, else black; a uniform image becomes the nearer of both."""
    if block_size <= 1 or block_size % 2 == 0:
        raise ValueError(f"block_size must be odd and above 1, got {block_size}")
    plain = gray(image)
    if plain.size and plain.min() == plain.max():
        return np.full(plain.shape, 255 if plain.flat[0] >= 128 else 0, dtype=np.uint8)
    return np.where(plain > np.rint(gaussian_mean(plain, block_size)) - c, 255, 0).astype(np.uint8)


def skew_angle(image: np.ndarray, limit: float = 45.0) -> float | None:
    """The rotation, in degrees counter-clockwise, that makes the rows of ink sharpest; None without ink. Found from projection profiles of all ink, coarse to fine."""
    dark = 255.0 - gray(image)
    ink = (dark > dark.mean()).astype(np.int32)
    if ink.sum() < 2 or not np.ptp(ink):
        return None
    height, width = ink.shape
    upto = np.concatenate([np.zeros((1, height), np.int32), np.cumsum(ink.T, axis=0, dtype=np.int32)])  # ink of the columns before each

    def sharpness(angle: float) -> float:
        """Columns that are sheared by the same number of rows are taken together."""
        shear = np.rint((np.arange(width) - width / 2) * np.tan(np.radians(angle))).astype(int)
        first = np.flatnonzero(np.concatenate([[True], shear[1:] != shear[:-1]]))
        profile = np.zeros(height + int(np.ptp(shear)), np.int64)
        for begin, end in zip(first, np.append(first[1:], width), strict=True):
            down = int(shear.max() - shear[begin])
            profile[down : down + height] += upto[end] - upto[begin]
        return float((np.diff(profile) ** 2).sum()) * np.cos(np.radians(angle))

    best = 0.0
    for step in (1.0, 0.25, 0.05):
        near = np.arange(-limit, limit + step / 2, step) if step == 1.0 else best + np.arange(-5, 6) * step
        best = float(max(near, key=lambda a: (sharpness(a), -abs(a))))
    return best


def rotate(image: np.ndarray, angle: float) -> np.ndarray:
    """About the centre, counter-clockwise, same size, cubic interpolation, white where nothing was."""
    h, w = image.shape[:2]
    rad, cy, cx = np.radians(angle), h / 2, w / 2
    yy, xx = np.mgrid[0:h, 0:w].astype(np.float64)
    sx = np.cos(rad) * (xx - cx) - np.sin(rad) * (yy - cy) + cx
    sy = np.sin(rad) * (xx - cx) + np.cos(rad) * (yy - cy) + cy
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    layers = image.reshape(h, w, -1).astype(np.float64)
    out = np.zeros_like(layers)

    def weight(d: np.ndarray, a: float = -0.75) -> np.ndarray:
        d = np.abs(d)
        return np.where(d <= 1, ((a + 2) * d - (a + 3)) * d * d + 1, np.where(d < 2, ((a * d - 5 * a) * d + 8 * a) * d - 4 * a, 0.0))

    for dy in range(-1, 3):
        for dx in range(-1, 3):
            py, px = y0 + dy, x0 + dx
            inside = (py >= 0) & (py < h) & (px >= 0) & (px < w)
            pixel = np.where(inside[..., None], layers[np.clip(py, 0, h - 1), np.clip(px, 0, w - 1)], 255.0)
            out += pixel * (weight(sx - px) * weight(sy - py))[..., None]
    return np.clip(np.rint(out), 0, 255).astype(np.uint8).reshape(image.shape)


def deskew(image: np.ndarray, threshold: float = 0.5) -> np.ndarray:
    """Turned by its skew; the same array if there is none to speak of."""
    if threshold < 0:
        raise ValueError(f"threshold must not be negative, got {threshold}")
    angle = skew_angle(_checked(image))
    return image if angle is None or abs(angle) < threshold else rotate(image, angle)


def _box(values: np.ndarray, size: int) -> np.ndarray:
    """Sums over squares of the given odd size; the border is mirrored."""
    half = size // 2
    wide = np.pad(values, half, mode="reflect")
    total = np.pad(wide.cumsum(0, dtype=np.float64).cumsum(1), ((1, 0), (1, 0)))
    return total[size:, size:] - total[:-size, size:] - total[size:, :-size] + total[:-size, :-size]


def non_local_means(layers: np.ndarray, h: float = 7.0, template: int = 7, search: int = 21) -> np.ndarray:
    """Each pixel becomes the mean of those around it, weighted by how alike their surroundings are. layers: height by width by channels, treated together.

    One shift of the window at a time, so memory stays at a few times the image."""
    height, width, channels = layers.shape
    reach = min(search // 2, height - 1, width - 1)
    values = layers.astype(np.float64)
    wide = np.pad(values, ((reach, reach), (reach, reach), (0, 0)), mode="reflect")
    total, weights = np.zeros_like(values), np.zeros((height, width))
    size = template if min(height, width) > template // 2 else 1
    for dy in range(2 * reach + 1):
        for dx in range(2 * reach + 1):
            moved = wide[dy : dy + height, dx : dx + width]
            weight = np.exp(-_box(((values - moved) ** 2).sum(axis=2), size) / (size * size * channels * h * h))
            weight[weight < 1e-3] = 0.0
            weights += weight
            total += weight[..., None] * moved
    return np.clip(np.rint(total / weights[..., None]), 0, 255).astype(np.uint8)


#: Linear sRGB to XYZ (D65) and its white point, as published.
_XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
_WHITE = np.array([0.950456, 1.0, 1.088754])


def to_lab(image: np.ndarray) -> np.ndarray:
    """BGR to CIE L*a*b*, scaled to bytes."""
    rgb = image[..., 2::-1].astype(np.float64) / 255
    linear = np.where(rgb > 0.04045, ((rgb + 0.055) / 1.055) ** 2.4, rgb / 12.92)
    xyz = linear @ _XYZ.T / _WHITE
    f = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16 / 116)
    lab = np.stack([(116 * f[..., 1] - 16) * 255 / 100, 500 * (f[..., 0] - f[..., 1]) + 128, 200 * (f[..., 1] - f[..., 2]) + 128], axis=-1)
    return np.clip(np.rint(lab), 0, 255).astype(np.uint8)


def from_lab(lab: np.ndarray) -> np.ndarray:
    light, a, b = (lab[..., k].astype(np.float64) for k in range(3))
    fy = (light * 100 / 255 + 16) / 116
    f = np.stack([fy + (a - 128) / 500, fy, fy - (b - 128) / 200], axis=-1)
    xyz = np.where(f > 0.206893, f**3, (f - 16 / 116) / 7.787) * _WHITE
    linear = np.clip(xyz @ np.linalg.inv(_XYZ).T, 0, 1)
    rgb = np.where(linear > 0.0031308, 1.055 * linear ** (1 / 2.4) - 0.055, 12.92 * linear)
    return np.clip(np.rint(rgb[..., ::-1] * 255), 0, 255).astype(np.uint8)


def denoise(image: np.ndarray) -> np.ndarray:
    """Non-local means: strength 7, template 7, search 21. In colour, the lightness is one layer and the two colour layers are treated together."""
    if _checked(image).ndim == 2:
        return non_local_means(image[..., None])[..., 0]
    lab = to_lab(image)
    return from_lab(np.concatenate([non_local_means(lab[..., :1]), non_local_means(lab[..., 1:])], axis=2))


def equalized(layer: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Adaptive histogram equalisation: each tile's histogram is cut at ``clip`` times its mean, what was cut is spread evenly, and a pixel is mapped by the nearest four tiles in proportion."""
    height, width = layer.shape
    wide = np.pad(layer, ((0, -height % tiles), (0, -width % tiles)), mode="reflect") if height > tiles and width > tiles else np.pad(layer, ((0, -height % tiles), (0, -width % tiles)), mode="edge")
    th, tw = wide.shape[0] // tiles, wide.shape[1] // tiles
    area = th * tw
    limit = max(int(clip * area / 256), 1)
    tables = np.empty((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            histogram = np.bincount(wide[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
            cut = int(np.maximum(histogram - limit, 0).sum())
            histogram = np.minimum(histogram, limit) + cut // 256
            if rest := cut % 256:
                step = max(256 // rest, 1)
                histogram[: step * rest : step] += 1
            tables[i, j] = np.clip(np.rint(histogram.cumsum() * 255 / area), 0, 255)

    def near(n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.arange(n) / size - 0.5
        low = np.floor(at).astype(int)
        return np.clip(low, 0, tiles - 1), np.clip(low + 1, 0, tiles - 1), at - low

    (y0, y1, fy), (x0, x1, fx) = near(height, th), near(width, tw)
    pick = lambda y, x: tables[y[:, None], x[None, :], layer]
    top = pick(y0, x0) * (1 - fx) + pick(y0, x1) * fx
    bottom = pick(y1, x0) * (1 - fx) + pick(y1, x1) * fx
    return np.clip(np.rint(top * (1 - fy[:, None]) + bottom * fy[:, None]), 0, 255).astype(np.uint8)


def contrast(image: np.ndarray) -> np.ndarray:
    """Adaptive histogram equalisation (clip 2.0, 8 by 8 tiles), of the lightness only in colour."""
    if _checked(image).ndim == 2:
        return equalized(image)
    lab = to_lab(image)
    lab[..., 0] = equalized(lab[..., 0])
    return from_lab(lab)


class Pipeline:
    """Named stages in order, each on or off by default."""

    def __init__(self, stages: list[tuple[str, Stage, bool]]):
        names = [name for name, _, _ in stages]
        if len(set(names)) < len(names):
            raise ValueError(f"stage names must be unique: {names}")
        self.stages = list(stages)

    def chosen(self, enable: dict[str, bool] | None = None) -> list[tuple[str, Stage]]:
        enable = enable or {}
        if unknown := sorted(set(enable) - {name for name, _, _ in self.stages}):
            raise ValueError(f"unknown stages: {', '.join(unknown)}")
        return [(name, stage) for name, stage, on in self.stages if enable.get(name, on)]

    def run(self, image: np.ndarray, enable: dict[str, bool] | None = None) -> np.ndarray:
        for _, stage in self.chosen(enable):
            image = stage(image)
        return image


def default_pipeline() -> Pipeline:
    """The stages' order and which are on."""
    return Pipeline([("deskew", deskew, True), ("denoise", denoise, False), ("contrast", contrast, False), ("binarize", binarize, True)])


#: Which stages make each variant; "raw" is none.
VARIANTS = {
    "raw": {"deskew": False, "denoise": False, "contrast": False, "binarize": False},
    "deskew_only": {"deskew": True, "denoise": False, "contrast": False, "binarize": False},
    "grayscale_soft": {"deskew": True, "denoise": True, "contrast": True, "binarize": False},
    "all_4_stages": {"deskew": True, "denoise": True, "contrast": True, "binarize": True},
    "preprocessed": {"deskew": True, "denoise": False, "contrast": False, "binarize": True},
}

PIXELS = "height int, width int, channels int, pixels binary, error string"


def to_array(height: int, width: int, channels: int, pixels: bytes) -> np.ndarray:
    flat = np.frombuffer(pixels, dtype=np.uint8)
    return flat.reshape(height, width) if channels == 1 else flat.reshape(height, width, channels)


def apply(df: DataFrame, pipeline: Pipeline, enable: dict[str, bool] | None = None, keys: tuple[str, ...] = ("book_id", "page_id")) -> DataFrame:
    """All stages in one pass over (keys, height, width, channels, pixels). A page that fails keeps its row, with the error."""
    pipeline.chosen(enable)  # unknown names fail on the driver
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                try:
                    made = pipeline.run(to_array(row.height, row.width, row.channels, row.pixels), enable)
                    result = (made.shape[0], made.shape[1], 1 if made.ndim == 2 else made.shape[2], made.tobytes(), None)
                except Exception as e:  # one page must not end the run
                    result = (None, None, None, None, f"{type(e).__name__}: {e}")
                rows.append((*(getattr(row, k) for k in keys), *result))
            out = pd.DataFrame(rows, columns=[*keys, "height", "width", "channels", "pixels", "error"])
            yield out.astype({c: "Int32" for c in ("height", "width", "channels")})

    return df.select(*keys, "height", "width", "channels", "pixels").mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + PIXELS)
