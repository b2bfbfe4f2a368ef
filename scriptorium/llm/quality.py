"""Quality classifier: a generalised additive model with pairwise interactions (operator 3).

Each feature of a text is cut into quantile bins and has a lookup table over them. The tables are
learnt by cyclic boosting: round after round, each feature in turn gets a small step from a shallow
tree (two cuts at most) fitted to the gradient of the logistic loss. Afterwards the feature pairs
whose residuals gain most from a two-by-two split get tables over pairs of bins in the same way.
A score is the logistic of the intercept plus one entry of each table, added up for all texts of a
batch at once.

It is fitted on the driver to ``SAMPLE`` labelled rows at most, chosen by a hash of the id; only
their features are collected. Features come from the text alone.

Cases: a null text is an empty one and gets the model's score for it. Labels that are null, or rows
without a document, teach nothing; a model without labels scores 0.5, one with a single label
scores that label's smoothed share. Repeated ids give a row each. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.support import arrow_map, bounded_sample, crc_mod, sized, texts, written

SAMPLE = 30_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE = 150, 60, 0.15
#: Weight of the second derivatives that a leaf needs.
LEAST_WEIGHT = 1.0

FEATURES = ("log_bytes", "upper_share", "digit_share", "punctuation_share", "bar_share", "symbol_share", "shout_share", "stop_share", "line_share", "space_share", "other_script_share", "top_byte_share", "byte_entropy", "word_length", "short_word_share", "distinct_words", "distinct_lines", "words_per_line")


def _set(chars: str) -> np.ndarray:
    out = np.zeros(256)
    out[[ord(c) for c in chars]] = 1
    return out


_UPPER, _LOWER, _DIGIT = _set("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _set("abcdefghijklmnopqrstuvwxyz"), _set("0123456789")
_CLASSES = np.stack([_UPPER, _LOWER, _DIGIT, _set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"), _set("|"), _set("#$%&*@^~<>{}[]\\=+_"), _set("!?"), _set(".,;:"), _set("\n"), _set(" \t\r\n\x0b\x0c"), np.arange(256) >= 128], axis=1)


def _distinct_share(parts: pa.Array, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text, the share of distinct parts and their number."""
    counts = np.bincount(owner, minlength=n)
    if not len(owner):
        return np.ones(n), counts
    codes = parts.dictionary_encode().indices.to_numpy().astype(np.int64)
    pairs = np.unique(owner * (codes.max() + 1) + codes)
    return np.where(counts > 0, np.bincount(pairs // (codes.max() + 1), minlength=n) / np.maximum(counts, 1), 1.0), counts


def features(column: pa.Array) -> np.ndarray:
    """A row of ``FEATURES`` for each text."""
    column = texts(column)
    n = len(column)
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    counts = np.stack([np.bincount(raw[a:b], minlength=256) for a, b in zip(ends[:-1], ends[1:], strict=True)]) if n else np.zeros((0, 256))
    total = np.maximum(sizes, 1)[:, None]
    share = counts / total
    classes = counts @ _CLASSES
    letters = np.maximum(classes[:, 0] + classes[:, 1], 1)
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
    lists = pc.ascii_split_whitespace(column)
    words = lists.flatten()
    owner = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    real = lengths > 0
    words, owner, lengths = words.filter(pa.array(real)), owner[real], lengths[real]
    distinct, n_words = _distinct_share(words, owner, n)
    some = np.maximum(n_words, 1)
    lines = pc.split_pattern(column, "\n")
    distinct_lines, n_lines = _distinct_share(lines.flatten(), np.repeat(np.arange(n), np.diff(lines.offsets.to_numpy())), n)
    by_total = classes / total
    return np.stack([
        np.log1p(sizes), classes[:, 0] / letters, by_total[:, 2], by_total[:, 3], by_total[:, 4], by_total[:, 5], by_total[:, 6], by_total[:, 7], by_total[:, 8], by_total[:, 9], by_total[:, 10],
        share.max(axis=1, initial=0), entropy, np.bincount(owner, weights=lengths, minlength=n) / some, np.bincount(owner, weights=lengths <= 3, minlength=n) / some, distinct, distinct_lines, n_words / np.maximum(n_lines, 1),
    ], axis=1)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _leaf(gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return gradient / (weight + 1.0)


def shallow_tree(gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The step of each bin: a tree of two cuts at most over sums of gradients and weights by bin."""
    step = np.full(len(gradient), _leaf(gradient.sum(), weight.sum()))
    pieces = [(0, len(gradient))]
    for _ in range(2):
        best = None
        for lo, hi in pieces:
            g, w = np.cumsum(gradient[lo:hi]), np.cumsum(weight[lo:hi])
            if hi - lo < 2:
                continue
            left_g, left_w, right_g, right_w = g[:-1], w[:-1], g[-1] - g[:-1], w[-1] - w[:-1]
            gain = np.where((left_w >= LEAST_WEIGHT) & (right_w >= LEAST_WEIGHT), left_g**2 / (left_w + 1) + right_g**2 / (right_w + 1) - g[-1] ** 2 / (w[-1] + 1), -np.inf)
            at = int(gain.argmax())
            if gain[at] > 0 and (best is None or gain[at] > best[0]):
                best = (gain[at], lo, lo + at + 1, hi)
        if best is None:
            break
        _, lo, cut, hi = best
        pieces.remove((lo, hi))
        pieces += [(lo, cut), (cut, hi)]
        for a, b in ((lo, cut), (cut, hi)):
            step[a:b] = _leaf(gradient[a:b].sum(), weight[a:b].sum())
    return step


def quadrants(gradient: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """The best two-by-two split of a table of sums: its gain and the step of each cell."""
    g, w = gradient.cumsum(0).cumsum(1), weight.cumsum(0).cumsum(1)
    rows, columns = gradient.shape
    if rows < 2 or columns < 2:
        return 0.0, np.zeros_like(gradient)
    parts = []
    for x in (g, w):
        a = x[:-1, :-1]
        b, c = x[:-1, -1:] - a, x[-1:, :-1] - a
        parts.append((a, b, c, x[-1, -1] - a - b - c))
    gain = sum(p**2 / (q + 1) for p, q in zip(*parts, strict=True)) - g[-1, -1] ** 2 / (w[-1, -1] + 1)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    step = np.zeros_like(gradient)
    for k, (r, c) in enumerate(((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None)))):
        step[r, c] = _leaf(parts[0][k][i, j], parts[1][k][i, j])
    return float(gain[i, j]), step


class Model:
    """Cuts and a table for each feature, coarser cuts for pairs, and tables for the chosen pairs."""

    def __init__(self, intercept: float, cuts: list, tables: list, coarse: list, pairs: list):
        self.intercept, self.cuts, self.tables, self.coarse, self.pairs = intercept, cuts, tables, coarse, pairs

    def parts(self) -> tuple:
        return self.intercept, self.cuts, self.tables, self.coarse, self.pairs

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for k, (cuts, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += table[np.searchsorted(cuts, x[:, k], side="right")]
        for i, j, table in self.pairs:
            total += table[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return _logistic(total)


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    share = (y.sum() + 0.5) / (len(y) + 1)
    intercept = float(np.log(share / (1 - share)))
    quantiles = lambda column, n: np.unique(np.quantile(column, np.arange(1, n) / n)) if len(column) else np.zeros(0)
    cuts = [quantiles(x[:, k], BINS) for k in range(x.shape[1])]
    coarse = [quantiles(x[:, k], PAIR_BINS) for k in range(x.shape[1])]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    if len(np.unique(y)) < 2:
        return Model(intercept, cuts, tables, coarse, [])
    bins = [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(cuts)]
    total = np.full(len(y), intercept)

    def sums(index: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        p = _logistic(total)
        return np.bincount(index, weights=y - p, minlength=n), np.bincount(index, weights=p * (1 - p), minlength=n)

    for _ in range(ROUNDS):
        for k, table in enumerate(tables):
            step = RATE * shallow_tree(*sums(bins[k], len(table)))
            table += step
            total += step[bins[k]]
    small = [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(coarse)]
    shape = [len(c) + 1 for c in coarse]
    flat = {(i, j): small[i] * shape[j] + small[j] for i, j in combinations(range(x.shape[1]), 2)}
    square = lambda i, j: [s.reshape(shape[i], shape[j]) for s in sums(flat[i, j], shape[i] * shape[j])]
    chosen = sorted(flat, key=lambda p: -quadrants(*square(*p))[0])[:PAIRS]
    pairs = [(i, j, np.zeros((shape[i], shape[j]))) for i, j in chosen]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in pairs:
            step = RATE * quadrants(*square(i, j))[1]
            table += step
            total += step.ravel()[flat[i, j]]
    return Model(intercept, cuts, tables, coarse, pairs)


def held_out(doc_id: Column) -> Column:
    return crc_mod(doc_id, 5) == 0


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = SAMPLE) -> Model:
    """Fit to the labelled documents that aren't held out: distinct pairs of text and label, about ``rows`` at most.

    Ids are chosen by their hash, then, if they stand for many texts, texts by theirs; so what is broadcast or collected is bounded by ``rows``, however often ids repeat."""
    usable = labels.filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id))).select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label")).distinct()
    chosen = bounded_sample(usable, F.col("id"), rows)
    taught = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")
    taught = written(taught.groupBy(F.xxhash64("text").alias("of"), "label").agg(F.first("text").alias("text")), "taught")
    taught = bounded_sample(taught, F.col("of"), rows).select("text", "label")
    names = ", ".join(f"f{k} double" for k in range(len(FEATURES)))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in sized(batches, "text"):
            x = features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("label"), *(pa.array(x[:, k]) for k in range(x.shape[1]))], names=["label", *(f"f{k}" for k in range(x.shape[1]))])

    found = arrow_map(taught, run, f"label int, {names}").toPandas().sort_values(by=["label", *(f"f{k}" for k in range(len(FEATURES)))])
    return fit(found.iloc[:, 1:].to_numpy(dtype=np.float64), found["label"].to_numpy(dtype=np.float64))


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of each row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model.parts())
    kind = dict(docs.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]):
        model_ = Model(*sent.value)
        for batch in sized(batches, text):
            score = model_.score(features(batch.column(batch.schema.get_field_index(text))))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(doc_id)), pa.array(score)], names=[doc_id, "score"])

    return arrow_map(docs.select(doc_id, text), run, f"`{doc_id}` {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs``."""
    scored = predict(docs, train(docs, labels, doc_id, text, label), doc_id, text)
    return scored.select(doc_id, held_out(F.col(doc_id)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
