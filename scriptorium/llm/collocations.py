"""Phrase collocation mining by contiguous pattern growth in the manner of PrefixSpan (operator 12).

1. ``counted`` counts every word, which gives n and f of all single words, and the codes (64-bit
   hashes) that stand for words from then on.
2. ``projected`` projects the occurrences of each first word: what follows it in its piece, up to the
   longest phrase's end, is a pointer. Pointers of a batch that agree are one with a number, and go to
   the task of their prefix, (lang, word), in one packed value for each batch.
3. ``grown`` sorts a prefix's pointers and extends it to the right depth-first: the pointers of an
   extension are a slice of its prefix's, and only extensions with enough occurrences are followed.

A prefix with more than ``share`` occurrences is dealt to several tasks by the word that follows it, which
leaves the counts of its extensions whole. A pair of words with as many is dealt by all that follows,
and the parts' counts of its shorter extensions are summed. Which pairs are frequent is learnt from batches that
hold many of them; what this misses costs balance, never a count.

``collocations`` scores each phrase by its worst cut with joins on the counts, in decimals of 38
digits, and drops what a longer phrase explains.

Cases: null and empty texts have no words; texts of any length are taken whole. A null language is
``und``, as is one of that name. Repeated rows all count. Ties are broken as the contract has them, so
the result is the same every time. A table without rows gives none. If two words of a language share a code, all
codes are drawn anew. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm.jaccard import _ODD, _mixed
from scriptorium.llm.support import arrow_map, gathered, sized, texts, written

LONGEST, LEAST, TOP = 3, 10, 2000
#: Percent of a phrase's occurrences that lie in a longer one for it to be dropped.
EXPLAINED = 50
#: Bytes of text whose pointers are counted together.
BATCH = 8 << 20
#: Occurrences of a prefix that one task takes, unless more than ``MAX_DEALT`` prefixes (they are broadcast) would have more.
SHARE, MAX_DEALT = 1 << 15, 1 << 20
#: A batch reports pairs that make up one in so many of its words, and the frequentest so many of all are dealt.
SEEN, MAX_PAIRS = 4096, 1 << 16
#: Slices of a language whose first phrases are found apart.
SLICES = 64
#: Draws of codes until no two words of a language share one.
DRAWS = 8

_CLASS = np.zeros(256, dtype=np.uint8)  # 0 a word's byte, 1 between words, 2 between pieces
_CLASS[[0x20, 0x09]] = 1
_CLASS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def tokens(column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """(all words in order, the text and the piece of each); pieces are numbered over all texts."""
    column = texts(column)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    kind = _CLASS[raw]
    word = kind == 0
    begins, closes = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    closes[:-1] &= ~word[1:]
    some = ends[:-1] < ends[1:]  # words end with their text
    begins[ends[:-1][some]] = word[ends[:-1][some]]
    closes[ends[1:][some] - 1] = word[ends[1:][some] - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    bounds = np.concatenate([[0], np.cumsum(stops - starts)])
    whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(_LOWER[raw[word]].tobytes())])
    text = np.searchsorted(ends, starts, side="right") - 1
    return whole.dictionary_encode(), text, np.searchsorted(np.flatnonzero(kind == 2), starts) + text


def codes(words: pa.Array, draw: int) -> np.ndarray:
    """A code other than 0 for each word."""
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed=draw) or 1 for w in words.to_pylist()), dtype=np.uint64, count=len(words))


class Batch:
    """The words of a batch of documents: for each its language, its code, and how many words its piece holds from it on."""

    def __init__(self, batch: pa.RecordBatch, draw: int):
        self.langs = batch.column(0).dictionary_encode()
        coded, text, piece = tokens(batch.column(1))
        self.words, self.at = coded.dictionary, coded.indices.to_numpy()
        self.own = codes(self.words, draw)
        self.lang = self.langs.indices.to_numpy()[text]
        last = np.flatnonzero(np.append(np.diff(piece) != 0, True)) if len(piece) else np.zeros(0, np.int64)
        self.room = (np.repeat(last, np.diff(np.concatenate([[-1], last]))) - np.arange(len(piece)) + 1) if len(piece) else piece

    def nodes(self, depth: int) -> list[np.ndarray]:
        """For each position and each length up to ``depth``, a number of its language and the words there; where the piece ends sooner, of those that are left."""
        out = [self.lang * np.int64(max(len(self.words), 1)) + self.at]
        for k in range(1, depth):
            follows = np.zeros(len(self.at), np.int64)
            follows[: len(self.at) - k] = self.at[k:] + 1
            follows[self.room <= k] = 0
            before = np.unique(out[-1], return_inverse=True)[1] if len(out[-1]) else out[-1]
            out.append(before * (len(self.words) + 1) + follows)
        return out

    def code(self, positions: np.ndarray, k: int) -> np.ndarray:
        """The code of the word ``k`` after each position; 0 where the piece has ended."""
        there = np.minimum(positions + k, max(len(self.at) - 1, 0))
        return np.where(self.room[positions] > k, self.own[self.at[there]], np.uint64(0)) if len(positions) else np.zeros(0, np.uint64)


def source(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text")).filter("text is not null")


def _batches(batches: Iterator[pa.RecordBatch], draw: int) -> Iterator[Batch]:
    for batch in gathered(sized(batches, "text"), "text", BATCH):
        yield Batch(batch, draw)


def counted(docs: DataFrame, draw: int) -> DataFrame:
    """(lang, word, code, after, n): occurrences of each word; and, without a word, of pairs (code, after) that a batch holds often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches, draw):
            words, pairs = b.nodes(2)
            for node, least in ((words, 1), (pairs[b.room > 1], max(len(words) // SEEN, 32))):
                positions = np.flatnonzero(b.room > 1) if node is not words else np.arange(len(words))
                _, first, n = np.unique(node, return_index=True, return_counts=True)
                first, n = positions[first[n >= least]], n[n >= least]
                lang = b.langs.dictionary.take(pa.array(b.lang[first]))
                word = b.words.take(pa.array(b.at[first])).cast(pa.large_string()) if node is words else pa.nulls(len(first), pa.large_string())
                after = np.zeros(len(first), np.uint64) if node is words else b.code(first, 1)
                yield pa.RecordBatch.from_arrays([lang.cast(pa.string()), word.cast(pa.string()), pa.array(b.code(first, 0).view(np.int64)), pa.array(after.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "word", "code", "after", "n"])

    return arrow_map(docs, run, "lang string, word string, code long, after long, n long").groupBy("lang", "word", "code", "after").agg(F.sum("n").alias("n"))


def _key(lang: np.ndarray | int, *parts: np.ndarray) -> np.ndarray:
    """One number of a language's hash and codes."""
    with np.errstate(over="ignore"):
        out = np.asarray(lang, dtype=np.uint64)
        for p in parts:
            out = _mixed((out ^ p) * _ODD + np.uint64(1))
    return out


def _lang_key(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang)


def _ways(rows: list, share: int, columns: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of what is dealt, and to how many tasks each."""
    keys = np.array([int(_key(_lang_key(r["lang"]), *(np.uint64(r[c] & 0xFFFFFFFFFFFFFFFF) for c in columns))) for r in rows], dtype=np.uint64)
    order = np.argsort(keys)
    return keys[order], np.array([-(-r["n"] // share) for r in rows], dtype=np.uint64)[order]


def _looked_up(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The ways of each key, 1 for keys that the table lacks."""
    known, ways = table
    if not len(known):
        return np.ones(len(keys), np.uint64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, ways[at], np.uint64(1))


def pointer_type(longest: int) -> np.dtype:
    """The codes that follow a prefix (0 where its piece has ended), and how often they do in a batch."""
    return np.dtype([("follow", "<u8", (longest - 1,)), ("n", "<u4")])


def projected(docs: DataFrame, draw: int, longest: int, dealt) -> DataFrame:
    """(lang, code, part, whole, pointers): of each batch the pointers of one prefix, packed: the codes that follow, then their number. ``whole`` is false where the parts' counts must be summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes, pairs = dealt.value
        for b in _batches(batches, draw):
            node = b.nodes(longest)[-1]
            able = np.flatnonzero(b.room > 1)
            _, first, n = np.unique(node[able], return_index=True, return_counts=True)
            at = able[first]
            follow = [b.code(at, k) for k in range(longest)]
            lang = np.array([_lang_key(x) for x in b.langs.dictionary.to_pylist()], dtype=np.uint64)[b.lang[at]] if len(at) else np.zeros(0, np.uint64)
            one, two = _key(lang, follow[0]), _key(lang, follow[0], follow[1])
            by_rest = _looked_up(pairs, two)
            by_next = _looked_up(prefixes, one)
            part = np.where(by_rest > 1, (_mixed(two) % by_next) * np.uint64(1 << 32) + _key(two, *follow[2:]) % by_rest + np.uint64(1), _mixed(two) % by_next * np.uint64(1 << 32))
            order = np.lexsort((part, b.at[at], b.lang[at]))
            at, n, part, by_rest, follow = at[order], n[order], part[order], by_rest[order], [f[order] for f in follow]
            fresh = np.concatenate([[True], (np.diff(b.lang[at]) != 0) | (np.diff(b.at[at]) != 0) | (part[1:] != part[:-1])]) if len(at) else np.zeros(0, bool)
            starts = np.flatnonzero(fresh)
            rows = np.zeros(len(at), pointer_type(longest))
            for k in range(1, longest):
                rows["follow"][:, k - 1] = follow[k]
            rows["n"] = n
            bounds = np.append(starts, len(at)) * rows.itemsize
            blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(rows.tobytes())])
            yield pa.RecordBatch.from_arrays([b.langs.dictionary.take(pa.array(b.lang[at[starts]])).cast(pa.string()), pa.array(follow[0][starts].view(np.int64)), pa.array(part[starts].view(np.int64)), pa.array(by_rest[starts] == 1), blob.cast(pa.binary())], names=["lang", "code", "part", "whole", "pointers"])

    return arrow_map(docs, run, "lang string, code long, part long, whole boolean, pointers binary")


def extended(pointers: np.ndarray, times: np.ndarray, depth: int, prefix: list[int], least: int, whole: bool, out: list) -> None:
    """Grow ``prefix`` to the right, depth-first. ``pointers`` are sorted by the codes that follow; those of each extension are a slice of them.

    Where the counts are only a part's, every extension but the longest is followed."""
    column = pointers[:, depth]
    starts = np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]]))
    sums = np.add.reduceat(times, starts)
    ends = np.append(starts[1:], len(column))
    last = depth + 1 == pointers.shape[1]
    for i in np.flatnonzero(((sums >= least) | (not whole and not last)) & (column[starts] != 0)):
        longer = [*prefix, int(column[starts[i]])]
        out.append((longer, int(sums[i])))
        if not last:
            extended(pointers[starts[i] : ends[i]], times[starts[i] : ends[i]], depth + 1, longer, least, whole, out)


def grown(pointers: DataFrame, longest: int, least: int) -> DataFrame:
    """(lang, phrase, n): occurrences of each phrase of two words and more that has ``least``; a phrase is an array of codes."""
    lined = pointers.repartition("lang", "code", "part").sortWithinPartitions("lang", "code", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(key: tuple, blobs: list[bytes]) -> list:
            rows = np.frombuffer(b"".join(blobs), pointer_type(longest))
            times = rows["n"].astype(np.int64)
            if key[3] and times.sum() < least:
                return []
            follow = rows["follow"]
            order = np.lexsort(follow[:, ::-1].T)
            out: list = []
            extended(follow[order], times[order], 0, [key[1]], least, key[3], out)
            return [(key[0], p, n) for p, n in out]

        def given(found: list) -> pa.RecordBatch:
            lists = pa.array([np.array(p, dtype=np.uint64).view(np.int64) for _, p, _ in found], pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([x for x, _, _ in found], pa.string()), lists, pa.array([n for _, _, n in found], pa.int64())], names=["lang", "phrase", "n"])

        held, blobs, found = None, [], []
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_numpy().view(np.uint64).tolist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True))
            for key, blob in zip(keys, batch.column(4), strict=True):
                if key[:3] != (held or ())[:3]:
                    found += made(held, blobs) if held else []
                    held, blobs = key, []
                blobs.append(blob.as_py())
            if len(found) > 10_000:
                yield given(found)
                found = []
        yield given(found + (made(held, blobs) if held else []))

    parts = arrow_map(lined, run, "lang string, phrase array<long>, n long")
    return parts.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def phrase_counts(docs: DataFrame, text: str, lang: str, longest: int, least: int, share: int = SHARE) -> tuple[DataFrame, DataFrame]:
    """((lang, word, code, n) of all words, (lang, phrase, n) of phrases that have ``least``, single words too)."""
    rows, spark = source(docs, text, lang), docs.sparkSession
    for draw in range(DRAWS):
        found = written(counted(rows, draw), "words")
        words = found.filter(F.col("word").isNotNull()).select("lang", "word", "code", "n")
        if not words.groupBy("lang", "code").agg(F.count("*").alias("k")).filter("k > 1").limit(1).count():
            break
    else:
        raise ValueError(f"words of one language shared a code in each of {DRAWS} draws")
    total = words.agg(F.sum("n")).first()[0] or 0
    # So many prefixes have more than the share at most; the pairs are cut to a number.
    share = max(share, -(-total // MAX_DEALT))
    prefixes = words.filter(F.col("n") > share).select("lang", "code", "n").collect()
    pairs = found.filter(F.col("word").isNull() & (F.col("n") > share)).orderBy(F.desc("n"), "lang", "code", "after").limit(MAX_PAIRS).collect()
    dealt = spark.sparkContext.broadcast((_ways(prefixes, share, ("code",)), _ways(pairs, share, ("code", "after"))))
    longer = written(grown(projected(rows, draw, longest, dealt), longest, least), "phrases")
    singles = words.filter(F.col("n") >= least).select("lang", F.array("code").alias("phrase"), "n")
    return words, singles.unionByName(longer)


def exact(x: Column) -> Column:
    return x.cast(T.DecimalType(15, 0))


def worst_cuts(counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score): of each phrase of two words and more the cut with the lowest score; ties go to the shortest first part."""
    size = F.size("phrase")
    longer = counts.filter(size > 1).select("lang", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = longer.withColumns({"left": F.slice("phrase", F.lit(1), F.col("k")), "right": F.slice("phrase", F.col("k") + 1, F.size("phrase"))})
    side = lambda part, name: counts.select("lang", F.col("phrase").alias(part), F.col("n").alias(name))
    both = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    product = (exact(F.col("a")) * exact(F.col("a")) * F.lit(1_000_000).cast(T.DecimalType(7, 0))).alias("x")
    scored = both.select("lang", "phrase", "a", "l", "r", "k", product, (exact(F.col("l")) * exact(F.col("r"))).alias("y"))
    least = scored.select("lang", "phrase", "a", F.struct(F.expr("x div y").alias("score"), "k", "l", "r").alias("cut")).groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut"))
    return least.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def unexplained(phrases: DataFrame, counts: DataFrame, percent: int) -> DataFrame:
    """``phrases`` without those that lie in a longer phrase of ``counts`` with ``percent`` of their occurrences or more."""
    size = F.size("phrase")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.slice("phrase", i, n))))
    inside = counts.filter(size > 2).select("lang", F.explode(spans).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    return phrases.join(inside, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("longer") < percent * F.col("a"), F.lit(True))).drop("longer")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, top: int = TOP, percent: int = EXPLAINED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``longest`` words."""
    words, counts = phrase_counts(docs, text, lang, longest, least)
    kept = unexplained(worst_cuts(counts), counts, percent)
    # What could be among the first, ties included, gets its words; only those are sorted by them. Slices of a language go first, so that no task gets every task's best.
    near = kept.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(SLICES)))
    for group in (("lang", "slice"), ("lang",)):
        level = Window.partitionBy(*group).orderBy(F.desc("score"), F.desc("a"))
        near = near.withColumn("level", F.rank().over(level)).filter(F.col("level") <= top)
    near = near.drop("level", "slice")
    each = near.select("*", F.posexplode("phrase").alias("place", "code")).join(words.select("lang", "code", "word"), ["lang", "code"])
    spelled = each.groupBy("lang", "phrase", "a", "l", "r", "score").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " ").alias("spelled"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "spelled")
    ranked = spelled.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    n = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(F.broadcast(n), "lang").select(F.col("lang").alias(lang), "rank", F.col("spelled").alias("phrase"), "a", "l", "r", "n", "score")
