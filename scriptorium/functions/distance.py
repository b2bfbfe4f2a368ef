"""Edit distances of whole Arrow batches, over characters or words.

Sequences become whole numbers first, so nothing bounds how many distinct words there are. Of every
pair the common beginning and end are dropped. If the shorter side then lies within the longer one, in
order, their lengths tell the distance. What is left is solved by a bit-parallel recurrence
(Myers, 1999; Hyyro, 2003): a 64-bit word holds 64 rows of the table, and one NumPy call advances all
words of all pairs of a group of similar length. Pairs that are few of their length go alone: diagonals are
followed first (Ukkonen, 1985), whose cost goes with length plus distance squared, and if they are too
far apart, one big integer holds a whole column. A batch is taken in parts of so many characters or
words, and groups hold so many bytes, so memory goes with neither the batch nor the table.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.functions.text import ITEMS, parts

#: 64-bit words of the shorter side up to which pairs are solved together, in groups that share an upper bound; and pairs that make that worth while.
WIDTHS = (1, 2, 3, 4, 5, 6, 8, 10, 13, 16, 20, 25, 32, 40, 50, 64, 80, 100, 128)
WORTH = 10
#: Bytes of all that one group takes.
GROUP_BYTES = 32 << 20
#: Seconds that a step along one diagonal and a step of a big integer take, about; they only decide which way is tried.
DIAGONAL, STEP, STEP_WORD = 4e-6, 6e-7, 8e-9


def trimmed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both without their common beginning and end."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    start = int(differ[0]) if len(differ) else n
    a, b = a[start:], b[start:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    stop = int(differ[0]) if len(differ) else n
    return a[: len(a) - stop], b[: len(b) - stop]


def within(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether all of ``a`` is found in ``b`` in order. No distance is below the difference of the lengths, and then it is that."""
    rest = iter(b.tolist())
    return all(c in rest for c in a.tolist())


def along_diagonals(a: np.ndarray, b: np.ndarray, limit: int) -> int | None:
    """The distance if it is ``limit`` at most. Each round lets every diagonal reach as far as one more edit allows."""
    goal, gap = len(b) - len(a), abs(len(b) - len(a))
    if gap > limit:
        return None

    def run(i: int, k: int) -> int:
        """How far row ``i`` of diagonal ``k`` goes on without an edit."""
        length = 16
        while True:
            x, y = a[i : i + length], b[i + k : i + k + length]
            n = min(len(x), len(y))
            differ = x[:n] != y[:n]
            at = int(differ.argmax()) if n else 0
            if n and differ[at]:
                return i + at
            i += n
            if n < length:
                return i
            length *= 4

    far = {0: run(0, 0)}
    if goal == 0 and far[0] == len(a):
        return 0
    for edits in range(1, limit + 1):
        reached = {}
        for k in range(-edits, edits + 1):
            if k > len(b) or -k > len(a) or abs(goal - k) > limit - edits:
                continue
            i = max(far.get(k, -2) + 1, far.get(k - 1, -2), far.get(k + 1, -2) + 1)
            i = min(i, len(a), len(b) - k)
            if i < max(0, -k):
                continue
            reached[k] = run(i, k)
        if reached.get(goal) == len(a):
            return edits
        far = reached
    return None


def by_column(a: Sequence, b: Sequence) -> int:
    """The distance with one step of whole-number operations for each item of ``b``."""
    if not len(a) or not len(b):
        return max(len(a), len(b))
    places: dict = {}
    for i, c in enumerate(a):
        places.setdefault(c, []).append(i)
    masks: dict = {}
    full, last = (1 << len(a)) - 1, len(a) - 1
    up, down, score = full, 0, len(a)
    for c in b:
        if (match := masks.get(c)) is None:
            bits = bytearray(len(a) // 8 + 1)
            for i in places.get(c, ()):
                bits[i >> 3] |= 1 << (i & 7)
            match = int.from_bytes(bits, "little")
            # Of words that occur once there can be millions, and none is needed again.
            if len(places.get(c, ())) > 1 or c not in places:
                masks[c] = match
        across = (((match & up) + up) ^ up) | match | down
        plus, minus = down | ~(across | up) & full, up & across
        score += (plus >> last) - (minus >> last) if last < 64 else bool(plus & (1 << last)) - bool(minus & (1 << last))
        plus, minus = ((plus << 1) | 1) & full, (minus << 1) & full
        up, down = minus | ~((match | down) | plus) & full, plus & (match | down)
    return score


def one_distance(a: np.ndarray, b: np.ndarray) -> int:
    """The distance of a long pair that is trimmed."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return len(b)
    column = len(b) * (STEP + STEP_WORD * len(a) / 64)
    limit = int((column / 4 / DIAGONAL) ** 0.5)
    if limit > 1 and (near := along_diagonals(a, b, limit)) is not None:
        return near
    return by_column(a.tolist(), b.tolist())


def group_distances(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Distances of pairs (shorter, longer) whose shorter sides are of about one length, none of them empty. Long texts go first, so that pairs which have ended are left out by a slice."""
    order = np.argsort([-len(b) for _, b in pairs], kind="stable")
    rows = [pairs[i] for i in order]
    n, words = len(rows), max((len(a) + 63) // 64 for a, _ in rows)
    sizes, steps = np.array([len(a) for a, _ in rows]), np.array([len(b) for _, b in rows])
    short, long = np.concatenate([a for a, _ in rows]), np.concatenate([b for _, b in rows])
    room = int(max(short.max(), long.max())) + 1
    keys, code = np.unique(np.repeat(np.arange(n), sizes) * room + short, return_inverse=True)
    wanted = np.repeat(np.arange(n), steps) * room + long
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    found = np.where(keys[at] == wanted, at + 1, 0)  # row 0 of the masks matches nowhere
    masks = np.zeros((len(keys) + 1) * words, np.uint64)
    # Rows that match nothing and differ by nothing stand before the first one, so that every pair's last row is the last bit of the last word.
    before = 64 * words - sizes
    place = np.arange(len(short)) - np.repeat(np.cumsum(sizes) - sizes - before, sizes)
    np.bitwise_or.at(masks, (code + 1) * words + place // 64, np.uint64(1) << (place % 64).astype(np.uint64))
    masks = masks.reshape(-1, words)
    # At each time, word w is at item (time - w), so that what it carries over meets the next word one time later.
    longest = int(steps[0])
    text = np.zeros((longest + 2 * words, n), np.int64)
    text[words + np.arange(len(long)) - np.repeat(np.cumsum(steps) - steps, steps), np.repeat(np.arange(n), steps)] = found * words
    flat, column = masks.ravel(), np.arange(words)[:, None]
    one, top = np.uint64(1), np.uint64(63)
    up, down = np.where(column < before // 64, np.uint64(0), ~np.uint64(0)), np.zeros((words, n), np.uint64)
    up[before // 64, np.arange(n)] <<= (before % 64).astype(np.uint64)
    carry_up, carry_down = np.zeros((words + 1, n), np.uint64), np.zeros((words + 1, n), np.uint64)
    carry_up[0] = one
    score = sizes.astype(np.int64)
    active = np.searchsorted(-(steps + words - 1), -np.arange(longest + words - 1), side="left")
    for t in range(longest + words - 1):
        m, k = int(active[t]), min(t + 1, words)
        eq = flat.take(text[words + t - k + 1 : words + t + 1, :m][::-1] + column[:k])
        pv, mv, in_up, in_down = up[:k, :m], down[:k, :m], carry_up[:k, :m], carry_down[:k, :m]
        xv = eq | mv
        eq |= in_down
        across = eq & pv
        across += pv
        across ^= pv
        across |= eq
        minus = pv & across
        across |= pv
        plus = np.invert(across, out=across)
        plus |= mv
        out_up, out_down = plus >> top, minus >> top
        if k == words:
            score[:m] += out_up[-1].view(np.int64)
            score[:m] -= out_down[-1].view(np.int64)
        plus <<= one
        plus |= in_up
        minus <<= one
        minus |= in_down
        carry_up[1 : k + 1, :m], carry_down[1 : k + 1, :m] = out_up, out_down
        np.bitwise_and(plus, xv, out=mv)
        xv |= plus
        np.invert(xv, out=pv)
        pv |= minus
    out = np.empty(n, np.int64)
    out[order] = score
    return out


def distances(a: np.ndarray, a_sizes: np.ndarray, b: np.ndarray, b_sizes: np.ndarray) -> np.ndarray:
    """The distance of each pair; the sequences of each side are joined and their sizes given apart."""
    out = np.zeros(len(a_sizes), np.int64)
    a_ends, b_ends = np.cumsum(a_sizes), np.cumsum(b_sizes)
    groups: dict[int, list] = {}
    for i in range(len(out)):
        x, y = trimmed(a[a_ends[i] - a_sizes[i] : a_ends[i]], b[b_ends[i] - b_sizes[i] : b_ends[i]])
        x, y = (x, y) if len(x) <= len(y) else (y, x)
        if not len(x) or len(x) < len(y) and within(x, y):
            out[i] = len(y) - len(x)
        else:
            groups.setdefault(bisect_left(WIDTHS, (len(x) + 63) // 64), []).append((i, x, y))
    for width, members in groups.items():
        if width == len(WIDTHS) or len(members) < WORTH:
            for i, x, y in members:
                out[i] = one_distance(x, y)
            continue
        members.sort(key=lambda m: len(m[2]))
        # Masks of distinct items, columns of the table, and what numbers the items of both sides.
        sizes = np.array([8 * ((len(np.unique(x)) + 12) * WIDTHS[width] + 5 * len(x) + 6 * len(y)) for _, x, y in members])
        for start, stop in parts(sizes, GROUP_BYTES):
            part = members[start:stop]
            out[[i for i, _, _ in part]] = group_distances([(x, y) for _, x, y in part])
    return out


def _code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = column.to_pylist()
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4"), np.array([len(t) for t in texts], dtype=np.int64)


def _solved(a: pa.Array, b: pa.Array, coded, sizes_of) -> pa.Array:
    """Distances of the rows that have both sides."""
    both = np.flatnonzero(a.is_valid().to_numpy(zero_copy_only=False) & b.is_valid().to_numpy(zero_copy_only=False))
    out = np.zeros(len(a), np.int64)
    sizes = sum(sizes_of(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (a, b))
    for start, stop in parts(sizes[both], ITEMS):
        rows = both[start:stop]
        out[rows] = distances(*coded(a.take(pa.array(rows)), b.take(pa.array(rows))))
    lacks = np.ones(len(a), bool)
    lacks[both] = False
    return pa.array(out.astype(np.int32), mask=lacks)


@F.arrow_udf(T.IntegerType())
def text_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    """Edit distance in code points, exact for texts of any length and distance; null if either is."""
    return _solved(a, b, lambda x, y: (*_code_points(x), *_code_points(y)), pc.binary_length)


def _word_codes(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    x, y = (pa.concat_arrays([c]).flatten().cast(pa.large_string()) for c in (a, b))
    codes = pa.concat_arrays([x, y]).dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)
    sizes = [c.value_lengths().to_numpy().astype(np.int64) for c in (a, b)]
    return codes[: len(x)], sizes[0], codes[len(x) :], sizes[1]


@F.arrow_udf(T.IntegerType())
def sequence_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    """Edit distance of two arrays of words, however many distinct ones there are; null if either is."""
    return _solved(a, b, _word_codes, pc.list_value_length)
