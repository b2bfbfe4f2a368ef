"""Burrows-Wheeler transforms of small string collections and their merge (the core of operator 5).

A shard holds distinct strings, each a cycle closed by one terminator (0xFF, which UTF-8 never
holds). ``build`` sorts a shard's rotations. ``merge`` takes any number of built shards and finds how
their rows interleave: it starts from the rows in order of their first two symbols and refines the
interleave. Slots that agree in ``h`` symbols form a block; in a round, the slots of a block are put
in order of the blocks that hold their rotations ``h`` symbols on, which looks at twice as many symbols.
Only blocks of several slots are open; settled ones take no part, and no rotation is compared
with another. Rows of one shard never change their order.

The ranks of all rounds give the common prefix of every slot with the one before it. Repeated
intervals are the maximal runs of slots whose common prefixes reach the wanted depth.

Cases: no strings give empty results; a string shorter than the depth is in no interval of it,
because its terminator makes its rotations differ from those of other strings or repeats the
string's own end. Equal strings in a shard are an error.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

TERMINATOR = 0xFF


class Cycles:
    """Joined cyclic strings: their bytes, and of each place the start and length of its cycle."""

    def __init__(self, data: np.ndarray, lengths: np.ndarray):
        """``data`` holds the strings one after the other, without terminators."""
        cycle = (lengths + 1).astype(np.int32)
        starts = np.cumsum(cycle, dtype=np.int64).astype(np.int32) - cycle
        self.lengths = lengths
        self.text = np.full(int(cycle.sum()), TERMINATOR, dtype=np.uint8)
        body = np.ones(len(self.text), bool)
        body[starts + lengths] = False
        self.text[body] = data
        self.string = np.repeat(np.arange(len(lengths), dtype=np.int32), cycle)
        self.first, self.cycle = starts[self.string], cycle[self.string]
        self.offset = np.arange(len(self.text), dtype=np.int32) - self.first

    def after(self, k: int, places: np.ndarray | slice = slice(None)) -> np.ndarray:
        """The place ``k`` symbols on, around the cycle."""
        offset, cycle = self.offset[places] + np.int32(k), self.cycle[places]
        over = np.flatnonzero(offset >= cycle)
        offset[over] %= cycle[over]
        return self.first[places] + offset

    def packed(self, width: int) -> np.ndarray:
        """``width`` symbols from each place on as one big-endian number."""
        out = np.zeros(len(self.text), dtype=np.uint64)
        for k in range(width):
            out <<= np.uint64(8)
            out |= self.text[self.after(k)]
        return out


def refined(cycles: Cycles, order: np.ndarray, fresh: np.ndarray, depth: int, levels: list | None = None, seen: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Refine an order of places whose blocks (``fresh`` marks their first slots) agree in ``seen`` symbols, until they agree in ``depth`` or are single.

    Returns the order and the marks. Equal ones keep their order. ``levels`` gathers (symbols, rank of each place) of every round."""
    n = len(order)
    rank = np.empty(n, dtype=np.int32)
    slot = np.arange(n, dtype=np.int32)
    head = np.maximum.accumulate(np.where(fresh, slot, 0)) if n else slot
    rank[order] = head
    if levels is not None:
        levels.append((seen, rank.copy()))
    open_ = np.flatnonzero(~(fresh & np.append(fresh[1:], True))) if n else slot
    while seen < depth and len(open_):
        step = min(seen, depth - seen)
        places = order[open_]
        key = (rank[places].astype(np.int64) << 32) | rank[cycles.after(step, places)]
        by = np.argsort(key, kind="stable")
        places, key = places[by], key[by]
        order[open_] = places
        parted = np.concatenate([[True], key[1:] != key[:-1]])
        fresh[open_] = parted
        rank[places] = np.maximum.accumulate(np.where(parted, open_, 0)).astype(np.int32)
        seen += step
        if levels is not None:
            levels.append((seen, rank.copy()))
        # A block's members lie next to each other among the open slots.
        open_ = open_[~(parted & np.append(parted[1:], True))]
    return order, fresh


def build(cycles: Cycles) -> np.ndarray:
    """The places of a shard (fewer than 2**31) in order of their rotations. The strings must be distinct, so no two rotations are equal."""
    key = cycles.packed(8)
    order = np.argsort(key, kind="stable").astype(np.int32)
    key = key[order]
    fresh = np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]])
    order, fresh = refined(cycles, order, fresh, 4 * int(cycles.cycle.max(initial=1)) + 16, seen=8)
    if not fresh.all():
        raise ValueError("the strings of a shard must be distinct")
    return order


@dataclass
class Merged:
    """Slot by slot: the place in the joined shards, its shard, and the common prefix with the slot before, ``depth`` at most."""

    place: np.ndarray
    shard: np.ndarray
    common: np.ndarray


def merge(every: Cycles, orders: list[np.ndarray], depth: int) -> Merged:
    """Interleave the rows of built shards up to ``depth`` symbols. every: the strings of all shards, one after the other; orders: each shard's own rows."""
    bases = np.concatenate([[0], np.cumsum([len(o) for o in orders])]).astype(np.int32)
    rows = np.concatenate([*(o + b for o, b in zip(orders, bases[:-1], strict=True)), np.zeros(0, np.int32)]).astype(np.int32)
    if not len(rows):
        return Merged(rows, rows, rows)
    start = min(2, depth)
    # A counting pass: sixteen-bit keys are sorted by radix, and rows of a shard stay in order.
    key = every.packed(start).astype(np.uint16)[rows]
    order = np.argsort(key, kind="stable")
    key = key[order]
    fresh = np.concatenate([[True], key[1:] != key[:-1]])
    levels: list[tuple[int, np.ndarray]] = [(1, every.text.astype(np.int32))]
    place, fresh = refined(every, rows[order], fresh, depth, levels, start)
    return Merged(place, np.searchsorted(bases, place, side="right") - 1, common_prefixes(every, place, fresh, levels, depth))


def common_prefixes(every: Cycles, place: np.ndarray, fresh: np.ndarray, levels: list[tuple[int, np.ndarray]], depth: int) -> np.ndarray:
    """Of each slot, the number of symbols that it shares with the slot before: what the ranks of each round, the farthest-seeing first, add up to."""
    out = np.full(len(place), depth, dtype=np.int32)
    out[:1] = 0
    at = np.flatnonzero(fresh)[1:]
    a, b = place[at - 1], place[at]
    shared = np.zeros(len(at), dtype=np.int32)
    left = np.arange(len(at))
    for seen, rank in levels[::-1]:
        same = left[rank[a[left]] == rank[b[left]]] if len(left) else left
        shared[same] += seen
        a[same], b[same] = every.after(seen, a[same]), every.after(seen, b[same])
    out[at] = np.minimum(shared, depth)
    return out


def interval_minima(data: np.ndarray, lengths: np.ndarray, values: np.ndarray, depth: int, shard_bytes: int = 1 << 18) -> np.ndarray:
    """For each place of the joined strings from which ``depth`` symbols follow: the least value of any string that holds those symbols. Other places get the largest long.

    The strings must be distinct. They are dealt to shards of about ``shard_bytes``; each is built on its own, and all are merged at once."""
    none = np.iinfo(np.int64).max
    out = np.full(len(data), none, dtype=np.int64)
    if not len(lengths):
        return out
    ends = np.cumsum(lengths)
    shard_of = (ends - 1) // shard_bytes
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard_of)) + 1, [len(lengths)]])
    orders = [build(Cycles(data[ends[lo] - lengths[lo] : ends[hi - 1]], lengths[lo:hi])) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
    every = Cycles(data, lengths)
    merged = merge(every, orders, depth)
    string, offset = every.string[merged.place], every.offset[merged.place]
    whole = offset + depth <= lengths[string]
    worth = np.where(whole, values[string], none)
    fresh = merged.common < depth
    least = np.minimum.reduceat(worth, np.flatnonzero(fresh))[np.cumsum(fresh) - 1]
    out[((ends - lengths)[string] + offset)[whole]] = least[whole]
    return out
