"""Language identification by segmentation-marginalised unigrams (operator 8).

Each language has a probability for every piece of a fixed public vocabulary, byte pieces included.
A word's probability is the sum over all its segmentations into pieces, by the forward algorithm; a
text's is the product over its words. A character outside the vocabulary is spelled in byte pieces.
The prediction is the language with the highest probability, the score its posterior under equal
priors. The piece probabilities come from expectation-maximisation: expected piece counts over all
segmentations (forward and backward), summed by Spark, on ``SAMPLE`` distinct training texts at most.

Words are runs of letters, lower-cased, with a word-begin mark. Whole texts and words of any length
count, in training and prediction alike; products that could leave the range of a double are kept
relative to the last place, with their logarithms beside them.

Cases: null texts and texts without a letter are ``und`` with score 0; so is every text if no row
can be learnt from. Ties go to the first language by name. Rows may repeat (a repeated training text
counts as often as it occurs), ids may be null (the remainder of a null id is 0). More than
``MAX_LANGUAGES`` distinct labels are an error: the model is sent to every task, and its size is
pieces times languages. Only the named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.support import arrow_map, crc_mod, sized, texts, written

#: Training texts at most (of all languages, about), rounds of expectation-maximisation, share of each table that all languages have alike.
SAMPLE, ROUNDS, SMOOTHING = 30_000, 2, 0.01
MAX_LANGUAGES = 1000
#: Values of the hash that cuts the sample.
SCALE = 1 << 30
#: Words up to this length are gathered by length; longer ones are padded to the longest of a group.
SHORT = 40
#: Cells (characters, or characters times a quarter of the languages) that are worked on at a time.
CELLS = 400_000
#: The logarithm of the smallest double that is safe to multiply into.
LEAST_LOG = -650.0
BEGIN = "▁"
_K = np.uint64(0x9E3779B97F4A7C15)


def vocabulary(path: str) -> list[str]:
    """All pieces of a sentencepiece model but its control symbols, in its order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i))]


class Pieces:
    """The vocabulary as a hash table over arrays; piece ``n`` is a character outside it if there are no byte pieces, ``n + 1`` no piece at all."""

    SLOT_BITS = 17

    def __init__(self, names: list[str]):
        self.n = len(names)
        number = {x: i for i, x in enumerate(names)}
        self.bytes = np.array([number.get(f"<0x{b:02X}>", -1) for b in range(256)])
        self.spelt = bool((self.bytes >= 0).all())
        spelled = set(self.bytes.tolist())
        own = [(i, p) for i, p in enumerate(names) if i not in spelled]
        self.longest = max((len(p) for _, p in own), default=1)
        self.keys, self.ids = np.zeros(1 << self.SLOT_BITS, np.uint64), np.full(1 << self.SLOT_BITS, -1, np.int32)
        self.probes = 1
        for i, piece in own:
            key = self._hash(np.array([[ord(c) for c in piece]], dtype=np.uint64))[0]
            at, tried = int(key >> np.uint64(64 - self.SLOT_BITS)), 1
            while self.ids[at] >= 0:
                at, tried = (at + 1) % len(self.ids), tried + 1
            self.keys[at], self.ids[at], self.probes = key, i, max(self.probes, tried)

    @staticmethod
    def _step(h: np.ndarray, code: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (h ^ code) * _K
            return h ^ (h >> np.uint64(29))

    def _hash(self, codes: np.ndarray) -> np.ndarray:
        h = np.full(codes.shape[0], 7, dtype=np.uint64)
        for k in range(codes.shape[1]):
            h = self._step(h, codes[:, k])
        return self._slot_hash(h)

    @staticmethod
    def _slot_hash(h: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return h * np.uint64(0xD6E8FEB86659FD93) | np.uint64(1)

    def find(self, h: np.ndarray) -> np.ndarray:
        key = self._slot_hash(h)
        at = (key >> np.uint64(64 - self.SLOT_BITS)).astype(np.int64)
        held = self.keys[at]
        out = np.where(held == key, self.ids[at], np.int32(self.n + 1))
        open_ = np.flatnonzero((held != key) & (self.ids[at] >= 0))
        for step in range(1, self.probes):
            if not len(open_):
                break
            there = (at[open_] + step) % len(self.ids)
            same = self.keys[there] == key[open_]
            out[open_[same]] = self.ids[there[same]]
            open_ = open_[~same & (self.ids[there] >= 0)]
        return out

    def spans(self, codes: np.ndarray) -> list[np.ndarray]:
        """For each size from 1 on, the piece of that size from each place on (places by words). codes: words by characters, 0 beyond a word's end."""
        places = np.ascontiguousarray(codes.T)
        length, words = places.shape
        h = np.full((length, words), 7, dtype=np.uint64)
        out = []
        for k in range(min(self.longest, length)):
            h = self._step(h[: length - k], places[k:])
            ids = self.find(h.ravel()).reshape(h.shape)
            out.append(np.where(places == 0, np.int32(self.n + 1), np.minimum(ids, self.n)) if k == 0 else ids)
        return out


class Block:
    """Some words with the pieces in them, and a piece table with a row for each character that is spelled in bytes."""

    def __init__(self, pieces: Pieces, table: np.ndarray, codes: np.ndarray):
        self.pieces, self.spans, self.table = pieces, pieces.spans(codes), table
        self.length, self.words = codes.shape[1], codes.shape[0]
        self.ends = (codes > 0).sum(axis=1)
        self.rows = table.shape[0]
        self.spelling: list[np.ndarray] = []
        unknown = self.spans[0] == pieces.n
        if pieces.spelt and unknown.any():
            chars, inverse = np.unique(codes.T[unknown], return_inverse=True)
            self.spelling = [pieces.bytes[list(chr(int(c)).encode("utf-8", "surrogatepass"))] for c in chars]
            self.spans[0][unknown] = self.rows + inverse
            self.table = np.concatenate([table, np.array([table[b].prod(axis=0) for b in self.spelling])])
        #: Whether any word has a piece there.
        self.some = [(ids != pieces.n + 1).any(axis=1) for ids in self.spans]
        used = self.table[: pieces.n].min(initial=1.0), self.table[self.rows :].min(initial=1.0)
        self.plain = self.length * np.log(min(used)) > LEAST_LOG

    def to(self, end: int) -> Iterator[tuple[int, np.ndarray]]:
        """(start, pieces) of all spans that end there."""
        for k, ids in enumerate(self.spans[:end]):
            if self.some[k][end - k - 1]:
                yield end - k - 1, ids[end - k - 1]

    def fold(self, counts: np.ndarray) -> np.ndarray:
        """Counts by piece, with those of spelled characters given to their bytes."""
        out = counts[: self.rows].copy()
        for row, own in zip(counts[self.rows :], self.spelling, strict=True):
            np.add.at(out, own, row)
        return out


def by_length(words: list[str], cells: int = CELLS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of the words, their characters) for words of one length, or of similar ones beyond ``SHORT``; a word-begin mark comes first."""
    lengths = np.array([len(w) for w in words])
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    starts = np.cumsum(lengths) - lengths
    near = np.where(lengths <= SHORT, lengths, SHORT + np.ceil(8 * np.log2(np.maximum(lengths, 1) / SHORT)).astype(int))
    for size in np.unique(near):
        at = np.flatnonzero(near == size)
        longest = int(lengths[at].max())
        for part in np.array_split(at, min(len(at), max(1, len(at) * longest // cells))):
            block = np.zeros((len(part), int(lengths[part].max()) + 1), np.uint64)
            block[:, 0] = ord(BEGIN)
            own = lengths[part]
            row, column = np.repeat(np.arange(len(part)), own), np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
            block[row, column + 1] = codes[starts[part][row] + column]
            yield part, block


def forward_plain(block: Block) -> np.ndarray:
    """The log-probability of each word, all of one length, in each language."""
    languages = block.table.shape[1]
    alpha = [np.ones((block.words, languages))]
    for end in range(1, block.length + 1):
        total = np.zeros((block.words, languages))
        for start, ids in block.to(end):
            total += alpha[start] * block.table[ids]
        alpha.append(total)
    return np.log(alpha[-1])


def forward_scaled(block: Block) -> np.ndarray:
    """The same for words of any lengths: what is kept of the last places is relative to the place before."""
    languages = block.table.shape[1]
    near, logs = {0: np.ones((block.words, languages))}, np.zeros((block.words, languages))
    for end in range(1, block.length + 1):
        total = np.zeros((block.words, languages))
        for start, ids in block.to(end):
            total += near[start] * block.table[ids]
        total[block.ends < end] = 1
        logs += np.log(total)
        near.pop(end - block.pieces.longest, None)
        for start in near:
            # Beyond a spelled character nothing is read any more, so what would overflow there is cut.
            near[start] = np.minimum(near[start] / total, 1e290)
        near[end] = np.ones((block.words, languages))
    return logs


def word_scores(pieces: Pieces, table: np.ndarray, words: list[str]) -> np.ndarray:
    """Log-probability of each word in each language."""
    out = np.zeros((len(words), table.shape[1]))
    for at, codes in by_length(words, CELLS * 4 // max(4, table.shape[1])) if words else ():
        block = Block(pieces, table, codes)
        out[at] = forward_plain(block) if block.plain and (block.ends == block.length).all() else forward_scaled(block)
    return out


def _logs(block: Block, given: list[np.ndarray], back: bool) -> np.ndarray:
    """Logarithms of the forward (or, from behind, backward) sums at each place. given: the probability of each span, as in ``Block.spans``."""
    logs = np.zeros((block.length + 1, block.words))
    near = {block.length if back else 0: np.ones(block.words)}
    for place in range(block.length - 1, -1, -1) if back else range(1, block.length + 1):
        total = np.zeros(block.words)
        for k, p in enumerate(given):
            start = place if back else place - k - 1
            other = place + k + 1 if back else start
            if 0 <= start < len(p) and block.some[k][start]:
                total += near[other] * p[start]
        total[block.ends <= place if back else block.ends < place] = 1
        logs[place] = logs[place + 1 if back else place - 1] + np.log(total)
        near.pop(place + block.pieces.longest if back else place - block.pieces.longest, None)
        for other in near:
            near[other] = np.minimum(near[other] / total, 1e290)
        near[place] = np.ones(block.words)
    return logs


def expected_counts(pieces: Pieces, table: np.ndarray, words: list[str], language: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Expected counts (pieces by languages) over all segmentations of the words, each in its own language."""
    languages = table.shape[1]
    out = np.zeros((pieces.n + 1, languages))
    for at, codes in by_length(words, CELLS // 2) if words else ():
        block = Block(pieces, table, codes)
        lang, n, length = language[at], times[at], block.length
        given = [block.table[ids, lang] for ids in block.spans]
        found = np.zeros(len(block.table) * languages)
        if block.plain and (block.ends == length).all():
            alpha, beta = [np.ones(len(at))], [np.zeros(len(at)) for _ in range(length)] + [np.ones(len(at))]
            for end in range(1, length + 1):
                alpha.append(sum((alpha[start] * given[end - start - 1][start] for start, _ in block.to(end)), np.zeros(len(at))))
            for end in range(length, 0, -1):
                for start, _ in block.to(end):
                    beta[start] += beta[end] * given[end - start - 1][start]
            weight = lambda start, end: alpha[start] * given[end - start - 1][start] * beta[end] / alpha[length] * n
        else:
            fore, back = _logs(block, given, False), _logs(block, given, True)
            weight = lambda start, end: given[end - start - 1][start] * np.exp(np.minimum(fore[start] + back[end] - fore[-1], 690)) * n
        for end in range(1, length + 1):
            for start, ids in block.to(end):
                found += np.bincount(ids * languages + lang, weights=weight(start, end), minlength=len(found)) if block.words > 500 else 0
                if block.words <= 500:
                    np.add.at(found, ids * languages + lang, weight(start, end))
        out += block.fold(found.reshape(-1, languages))[: pieces.n + 1]
    return out


def letters(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words of a column of texts, the number of each word's place among them, and each text's word count."""
    clean = pc.replace_substring_regex(pc.utf8_lower(texts(column)), r"\P{L}+", " ")
    lists = pc.ascii_split_whitespace(clean)
    words = lists.flatten()
    real = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    at = lists.offsets.to_numpy()
    before = np.concatenate([[0], np.cumsum(real)])
    at = at - at[0]
    coded = words.filter(pa.array(real)).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), (before[at[1:]] - before[at[:-1]]).astype(np.int64)


class Model:
    """Languages and the piece probabilities (pieces, the unknown character and no piece, by languages)."""

    def __init__(self, names: list[str], languages: list[str], table: np.ndarray):
        self.names, self.languages, self.table = names, languages, table

    def parts(self) -> tuple:
        return self.names, self.languages, self.table


def _table(counts: np.ndarray) -> np.ndarray:
    """Probabilities from expected counts. Every language gives the same share to what all languages have on average and to any piece, so that one with few texts isn't likelier for unusual ones."""
    totals = counts.sum(axis=0)
    own = np.divide(counts, totals, out=np.full(counts.shape, 1 / len(counts)), where=totals > 0)
    common = (own[:, totals > 0].mean(axis=1) if (totals > 0).any() else own.mean(axis=1)) / 2 + 0.5 / len(counts)
    return np.concatenate([(1 - SMOOTHING) * own + SMOOTHING * common[:, None], np.zeros((1, counts.shape[1]))])


def fit(train: DataFrame, names: list[str], text: str = "text", lang: str = "lang", rows: int = SAMPLE, rounds: int = ROUNDS) -> Model:
    """Learn from (text, lang) of ``train``; rows without either don't count. rows: the bound on the sample.

    The sample is cut within each language, so that languages of few rows are learnt from all of them. A language that no letter of its texts teaches is left out."""
    usable = train.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).withColumn("hash", F.pmod(F.xxhash64("text", F.lit(17)), F.lit(SCALE)))
    found = usable.groupBy("lang").agg(F.count("*").alias("count"), F.min("hash").alias("least")).limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(r["lang"] for r in found)
    if not languages:
        return Model(names, [], np.zeros((len(names) + 2, 0)))
    # The hash of the text chooses, so copies are in or out together; they are one row each, with their number. The text with the least hash is always in.
    most = quota([r["count"] for r in found], rows)
    cut = F.create_map(*(x for r in found for x in (F.lit(r["lang"]), F.lit(max(r["least"] + 1, SCALE if r["count"] <= most else int(SCALE * most / r["count"]))))))
    chosen = usable.filter(F.col("hash") < cut[F.col("lang")])
    sample = written(chosen.groupBy(F.xxhash64("text").alias("of"), "lang").agg(F.first("text").alias("text"), F.count("*").alias("n")).drop("of"), "sample")
    spark = train.sparkSession
    table = _table(np.ones((len(names) + 1, len(languages))))
    number = {x: i for i, x in enumerate(languages)}
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((names, table))

        def run(batches: Iterator[pa.RecordBatch], sent=sent):
            names_, table_ = sent.value
            pieces, total = Pieces(names_), np.zeros((len(names_) + 1, len(languages)))
            for batch in sized(batches, "text"):
                words, index, counts = letters(batch.column("text"))
                of = np.repeat(np.array([number[x] for x in batch.column("lang").to_pylist()]), counts)
                pairs, pair = np.unique(index.astype(np.int64) * len(languages) + of, return_inverse=True)
                times = np.bincount(pair, weights=np.repeat(batch.column("n").to_numpy(), counts), minlength=len(pairs))
                total += expected_counts(pieces, table_, [words[i] for i in pairs // len(languages)], pairs % len(languages), times)
            at = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at[0].astype(np.int32)), pa.array(at[1].astype(np.int32)), pa.array(total[at])], names=["piece", "lang", "n"])

        # At most pieces times languages rows come back.
        sums = arrow_map(sample, run, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros((len(names) + 1, len(languages)))
        counts[sums["piece"], sums["lang"]] = sums["n"]
        table = _table(counts)
    taught = np.flatnonzero(counts.sum(axis=0) > 0)
    return Model(names, [languages[i] for i in taught], table[:, taught])


def quota(counts: list[int], rows: int) -> float:
    """The most rows of one language, so that all languages together have about ``rows``."""
    left, ordered = rows, sorted(counts)
    for i, n in enumerate(ordered):
        if n * (len(ordered) - i) > left:
            return max(1.0, left / (len(ordered) - i))
        left -= n
    return float(ordered[-1])


def posteriors(model: Model, pieces: Pieces, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of each text, the number of the likeliest language (-1 without letters or languages) and its posterior."""
    words, index, counts = letters(column)
    n = len(counts)
    if not model.languages or not n:
        return np.full(n, -1), np.zeros(n)
    each, owner = word_scores(pieces, model.table, words), np.repeat(np.arange(n), counts)
    total = np.stack([np.bincount(owner, weights=each[index, k], minlength=n) for k in range(len(model.languages))], axis=1)
    top = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    return np.where(counts > 0, total.argmax(axis=1), -1), np.where(counts > 0, top, 0.0)


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of each row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model.parts())
    kind = dict(docs.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]):
        m = Model(*sent.value)
        pieces = Pieces(m.names)
        for batch in sized(batches, text):
            best, score = posteriors(m, pieces, batch.column(batch.schema.get_field_index(text)))
            named = pa.array([m.languages[i] if i >= 0 else "und" for i in best], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(doc_id)), named, pa.array(score)], names=[doc_id, "lang_pred", "score"])

    return arrow_map(docs.select(doc_id, text), run, f"`{doc_id}` {kind}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    return crc_mod(doc_id, 3) == 1


def identify(docs: DataFrame, names: list[str], doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Learn from the rows that aren't held out and predict all: (doc_id, held_out, lang_pred, score)."""
    model = fit(docs.filter(~held_out(F.col(doc_id))), names, text, lang)
    return predict(docs, model, doc_id, text).select(doc_id, held_out(F.col(doc_id)).alias("held_out"), "lang_pred", "score")


def kept(docs: DataFrame, names: list[str], least: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without those that are rejected: no letter, or a posterior below ``least``. Decided in the same pass, so nothing is joined."""
    model = fit(docs.filter(~held_out(F.col(doc_id))), names, text, "lang")
    sent, schema = docs.sparkSession.sparkContext.broadcast(model.parts()), docs.schema

    def run(batches: Iterator[pa.RecordBatch]):
        m = Model(*sent.value)
        pieces = Pieces(m.names)
        for batch in sized(batches, text):
            best, score = posteriors(m, pieces, batch.column(batch.schema.get_field_index(text)))
            yield batch.filter(pa.array((best >= 0) & (score >= least)))

    return arrow_map(docs, run, schema)


def default_vocabulary(_: SparkSession | None = None) -> list[str]:
    import public_tokenizers

    return vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
