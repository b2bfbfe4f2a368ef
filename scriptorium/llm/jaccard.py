"""N-gram Jaccard join by grouped prefixes (operator 6).

A document's set holds the hashes (64 bits) of its distinct shingles. Documents with equal sets are
collapsed first; then those with the same prefix and size form one group, and only groups meet.

1. ``hot_shingles`` finds shingles that many documents share. They come last in the global order, so
   prefixes hold rare ones. The order decides how many candidates there are, never the result.
2. Two sets with Jaccard >= t share a shingle within their first n - ceil(t n) + 1. Groups that share
   one are candidates if size, positions and XOR bitmaps (a lower bound of the difference) allow it.
3. Candidates are expanded to members and verified on their whole texts.

Links are only needed up to components: in two rounds each list of a shingle is compared with one
leader, which is linear in the list; the last round takes all pairs whose components still differ,
so no link between components is lost, while groups of near copies are not expanded into all pairs.

Cases: a document without words (null and empty texts too) has an empty set and is linked with
nothing. Fewer words than a shingle make one shingle. Equal texts are linked, whatever their number.
A doc_id that repeats gives a row each time, with the component of its own text, so two texts under
one id are not tied together. Rows with a null id take full part; a component without any other id
has a null one. For such ids, and for ids that aren't integers, rows are written once with a number
of their own, which takes the id's place. Sets are of 64-bit shingle hashes throughout. Only the
named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.components import components
from scriptorium.llm.support import arrow_map, discard, free_shuffles, gathered, list_array, sized, texts, written

SHINGLE, PERCENT = 5, 80
#: Shingles are hot from so many documents; the hottest so many are kept in mind (their bytes are broadcast).
HOT, MAX_HOT = 8, 1 << 18
#: Documents of one batch from which a shingle is reported to the count.
SEEN = 2
#: Ids beyond which a semi-join isn't broadcast.
MAX_IDS = 500_000
#: Bits of the smallest and largest bitmap; between them, at least two for each shingle.
BITMAPS = (512, 1 << 16)
#: Leaders of each list in the second round.
LEADERS = 3
#: Components that hold a share of one in so many rows are at most so many.
HEAVY = 1000
#: Rows of a list in the last round; longer ones are dealt to blocks.
LIST = 4096
#: Names of helping columns; they begin like no column of a table should.
ROW, KEPT = "__jaccard_row", "__jaccard_kept"


def shingle_hashes(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all shingles of a column of texts, joined, and the number of each text's (with repeats)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts(column)))
    words = lists.flatten()
    real = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    at = lists.offsets.to_numpy()
    at = at - at[0]
    before = np.concatenate([[0], np.cumsum(real)])
    counts = (before[at[1:]] - before[at[:-1]]).astype(np.int64)
    coded = words.filter(pa.array(real)).dictionary_encode()
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
    h = own[coded.indices.to_numpy()] if len(own) else np.zeros(0, np.uint64)
    made = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    ends, made_ends = np.cumsum(counts), np.cumsum(made)
    starts = np.repeat(ends - counts - (made_ends - made), made) + np.arange(int(made.sum()))
    with np.errstate(over="ignore"):
        rolled, short = _mixed(h), []
        for k in range(1, size):
            short.append(rolled)
            longer = rolled.copy()
            longer[: max(len(h) - k, 0)] = _mixed(rolled[: max(len(h) - k, 0)] * _ODD + h[k:])
            rolled = longer
        out = rolled[starts] if len(h) else np.zeros(0, np.uint64)
        for words_, table in enumerate(short, 1):  # whole texts of fewer words
            few = np.flatnonzero(counts == words_)
            if len(few):
                out[(made_ends - made)[few]] = table[(ends - counts)[few]]
    return out, made


_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct_sets(column: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Each text's set as sorted hashes."""
    hashes, made = shingle_hashes(column, size)
    ends = np.cumsum(made)
    return [np.unique(hashes[e - m : e]) for e, m in zip(ends, made, strict=True)]


def hot_shingles(docs: DataFrame, text: str, size: int) -> np.ndarray:
    """Sorted hashes of the ``MAX_HOT`` most shared shingles at most. Each batch reports those that ``SEEN`` of its documents hold."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in gathered(batches, text, 16 << 20):
            every = np.concatenate([*(s for part in sized([batch], text) for s in distinct_sets(part.column(part.schema.get_field_index(text)), size)), np.zeros(0, np.uint64)])
            hashes, n = np.unique(every, return_counts=True)
            often = n >= SEEN
            yield pa.RecordBatch.from_arrays([pa.array(hashes[often].view(np.int64)), pa.array(n[often].astype(np.int64))], names=["token", "n"])

    counted = arrow_map(docs.select(text), run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= HOT)
    top = counted.orderBy(F.desc("n"), "token").limit(MAX_HOT).select("token")
    return np.sort(np.array([r["token"] for r in top.collect()], dtype=np.int64).view(np.uint64))


def head(docs: DataFrame, doc_id: str, text: str, hot: np.ndarray, size: int, percent: int) -> DataFrame:
    """(doc_id, n, fp, ph, bitmap, prefix): size and fingerprint of each set, its prefix in the global order and a hash of that."""
    sent = docs.sparkSession.sparkContext.broadcast(hot)
    kind = dict(docs.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]):
        known = sent.value
        for batch in sized(batches, text):
            n, fp, ph, bitmap, prefix = [], [], [], [], []
            for s in distinct_sets(batch.column(batch.schema.get_field_index(text)), size):
                take = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
                late = known[np.minimum(np.searchsorted(known, s), len(known) - 1)] == s if take and len(known) else np.zeros(len(s), bool)
                order = np.concatenate([s[~late], s[late]])[:take] if late.any() else s[:take]
                n.append(len(s))
                fp.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                ph.append(xxhash.xxh3_64_intdigest(order.tobytes()))
                bitmap.append(parity_bitmap(s))
                prefix.append(order)
            joined = np.concatenate([*prefix, np.zeros(0, np.uint64)]).view(np.int64)
            made = [pa.array(n, pa.int32()), pa.array(fp, pa.binary()), pa.array(np.array(ph, np.uint64).view(np.int64)), pa.array(bitmap, pa.binary()), list_array(joined, np.array([len(p) for p in prefix]), pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(doc_id)), *made], names=["doc_id", "n", "fp", "ph", "bitmap", "prefix"])

    return arrow_map(docs.select(doc_id, text), run, f"doc_id {kind}, n int, fp binary, ph long, bitmap binary, prefix array<long>")


def parity_bitmap(s: np.ndarray) -> bytes:
    """For each value of the lowest bits of the hashes, whether an odd number has it. Halves of a bitmap XORed give the next smaller one."""
    bits = min(max(BITMAPS[0], 1 << (2 * len(s) - 1).bit_length()), BITMAPS[1]) if len(s) else BITMAPS[0]
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the number of shingles that only one of two sets holds."""
    x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def may_link(n_x: Column, n_y: Column, i: Column, j: Column, percent: int) -> Column:
    """Size and position filter for a shared shingle at places i and j.

    Sets that link share ``least`` shingles or more, so their first common one leaves so many in both."""
    least = F.ceil((n_x + n_y) * percent / (100 + percent) - 1e-9)
    return (F.least(n_x, n_y) * 100 >= F.greatest(n_x, n_y) * percent) & (n_x - i >= least) & (n_y - j >= least)


def pruned(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (x, y) without those whose bitmaps differ in more bits than sets above the threshold can."""
    side = lambda name: nodes.select(F.col("rep").alias(name), F.col("n").alias(f"n_{name}"), F.col("bitmap").alias(f"b_{name}"))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            n = batch.column("n_x").to_numpy().astype(np.int64) + batch.column("n_y").to_numpy()
            differ = np.array([least_difference(a.as_py(), b.as_py()) for a, b in zip(batch.column("b_x"), batch.column("b_y"), strict=True)], dtype=np.int64)
            keep = (n - differ) * (100 + percent) >= 2 * percent * n
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("x", "y")], names=["x", "y"])

    return arrow_map(pairs.join(side("x"), "x").join(side("y"), "y").select("x", "y", "n_x", "n_y", "b_x", "b_y"), run, "x long, y long")


def verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The ``pairs`` whose whole texts meet the threshold. ``docs``: (doc_id, text)."""
    needed = pairs.select(F.explode(F.array("x", "y")).alias("doc_id")).distinct()
    needed = written(needed, "needed")
    few = needed.count() <= MAX_IDS
    chosen = written(docs.join(F.broadcast(needed) if few else needed, "doc_id", "left_semi"), "texts")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in sized(batches, "text_x"):
            # A text that takes part in many pairs of a batch is shingled once.
            coded = [batch.column(f"text_{s}").dictionary_encode() for s in "xy"]
            sets = [distinct_sets(c.dictionary, size) for c in coded]
            keep = []
            for i, j in zip(*(c.indices.to_numpy() for c in coded), strict=True):
                a, b = sets[0][i], sets[1][j]
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(len(a) > 0 and len(b) > 0 and 100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("x", "y")], names=["x", "y"])

    x, y = (chosen.select(F.col("doc_id").alias(s), F.col("text").alias(f"text_{s}")) for s in "xy")
    out = written(arrow_map(pairs.join(x, "x").join(y, "y").select("x", "y", "text_x", "text_y"), run, "x long, y long").distinct(), "edges")
    discard(needed, chosen)
    free_shuffles(docs.sparkSession)
    return out


def relabelled(comps: DataFrame, edges: DataFrame) -> DataFrame:
    """``comps`` (rep, comp) after the links in ``edges``."""
    of = lambda name: comps.select(F.col("rep").alias(name), F.col("comp").alias(f"c_{name}"))
    links = edges.join(of("x"), "x").join(of("y"), "y").select(F.col("c_x").alias("x"), F.col("c_y").alias("y")).filter("x <> y").distinct()
    links = written(links, "links")
    if not links.limit(1).count():
        return comps
    moved = components(links).select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    return written(comps.join(moved, "comp", "left").select("rep", F.coalesce("to", "comp").alias("comp")), "comps")


def within_lists(left: DataFrame, percent: int) -> DataFrame:
    """All (x, y) of a list of ``left`` that may link and differ in component.

    A list of more than ``LIST`` rows is dealt to blocks, and each two blocks meet under a key of their own, so no task gets a whole list."""
    sizes = left.groupBy("token").agg(F.count("*").alias("m")).filter(F.col("m") > LIST)
    long = written(sizes.select("token", F.ceil(F.col("m") / LIST).cast("int").alias("blocks")), "long")
    n_long = long.count()
    keys, apart = ["token"], F.lit(True)
    if n_long:
        dealt = left.join(F.broadcast(long) if n_long <= MAX_IDS else long, "token", "left").fillna(1, ["blocks"])
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rep", F.lit(29)), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        left = dealt.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
        # Two rows of one block meet under that block alone.
        keys, apart = ["token", "low", "high"], (F.col("a.block") != F.col("b.block")) | (F.col("a.low") == F.col("a.high"))
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    met = left.alias("a").join(left.alias("b"), reduce(and_, same) & (F.col("a.comp") < F.col("b.comp")) & apart & may_link(F.col("a.n"), F.col("b.n"), F.col("a.i"), F.col("b.i"), percent))
    return met.select(F.col("a.rep").alias("x"), F.col("b.rep").alias("y"))


def names_rows(docs: DataFrame, doc_id: str) -> bool:
    """Whether every row has an integer id of its own."""
    if dict(docs.dtypes)[doc_id] not in ("tinyint", "smallint", "int", "bigint"):
        return False
    return not docs.groupBy(doc_id).count().filter((F.col("count") > 1) | F.col(doc_id).isNull()).limit(1).count()


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs``."""
    source = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    if names_rows(source, "id"):
        found = linked(source.select(F.col("id").cast("long").alias("doc_id"), "text"), size, percent)
        return found.select(F.col("doc_id").alias(doc_id), "n_shingles", "component_id")
    rows = written(source.withColumn("doc_id", F.monotonically_increasing_id()), "rows")
    found = linked(rows.select("doc_id", "text"), size, percent).join(rows.select("doc_id", "id"), "doc_id")
    found = written(found, "numbered")
    least = found.groupBy("component_id").agg(F.min("id").alias("least"))
    # A component of very many rows is one key here, so its name is sent to all if the rows of larger ones bound their number.
    heavy = found.groupBy("component_id").count().filter(F.col("count") * HEAVY >= found.count()).select("component_id")
    warm = found.join(F.broadcast(least.join(heavy, "component_id")), "component_id")
    cold = found.join(F.broadcast(heavy), "component_id", "left_anti").join(least, "component_id")
    return warm.unionByName(cold).select(F.col("id").alias(doc_id), "n_shingles", F.col("least").alias("component_id"))


def linked(source: DataFrame, size: int, percent: int) -> DataFrame:
    """:func:`join` for (doc_id, text) whose ids are longs, distinct and never null."""
    heads = written(head(source, "doc_id", "text", hot_shingles(source, "text", size), size, percent), "heads")
    slim = written(heads.select("doc_id", "n", "fp", "ph"), "slim")
    # Copies and groups are found without prefixes and bitmaps, which are shuffled once.
    filled = slim.filter("n > 0")
    copies = written(filled.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("ph").alias("ph")), "copies")
    groups = copies.groupBy("ph", "n").agg(F.min("rep").alias("g"))
    placed = copies.join(groups, ["ph", "n"]).select(F.col("fp").alias("own"), "rep", "g")
    nodes = written(heads.join(placed, F.col("doc_id") == F.col("rep")).select("rep", "g", "n", "bitmap", "prefix"), "nodes")
    members = nodes.select("rep", "g", "n")
    discard(heads)
    free_shuffles(source.sparkSession)

    # Shingles of group prefixes that at least two groups, or two members of one, hold.
    listed = nodes.filter("rep = g").select("g", "n", F.posexplode("prefix").alias("i", "token"))
    grown = members.groupBy("g").agg(F.count("*").alias("m")).filter("m > 1").select("g", "m")
    weights = listed.select("token", "g").groupBy("token").agg(F.count("*").alias("lists"))
    shared = weights.filter("lists > 1").select("token")
    postings = written(listed.join(shared, "token").select("token", "g", "n", "i"), "postings")
    comps = members.select("rep", F.col("rep").alias("comp")).distinct()
    free_shuffles(source.sparkSession)

    # Round one: the smallest group of each list leads it; members of a group follow its own leader.
    lead = postings.groupBy("token").agg(F.min(F.struct("g", "n", "i")).alias("lead"))
    stars = postings.join(lead, "token").filter((F.col("g") != F.col("lead.g")) & may_link(F.col("n"), F.col("lead.n"), F.col("i"), F.col("lead.i"), percent))
    within = members.join(grown, "g").filter("rep <> g").select(F.col("g").alias("x"), F.col("rep").alias("y"))
    pairs = stars.select(F.col("lead.g").alias("x"), F.col("g").alias("y")).unionByName(within).distinct()
    comps = relabelled(comps, verified(pruned(written(pairs, "pairs"), nodes, percent), source, size, percent))

    # Round two: other leaders for each list, for what is still apart.
    def apart() -> DataFrame:
        """The members' postings, with components, of shingles that more than one component holds; a group's members share them all."""
        inside = members.join(grown, "g").join(comps, "rep").groupBy("g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("g")
        alone = nodes.filter("rep = g").join(inside, "g", "left_semi").select(F.element_at("prefix", 1).alias("token"), "g", "n", F.lit(0).alias("i"))
        every = postings.unionByName(alone.join(postings.select("token", "g"), ["token", "g"], "left_anti"))
        rows = every.join(members.select("rep", "g"), "g").join(comps, "rep").select("token", "rep", "comp", "n", "i")
        mixed = rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("token")
        return written(rows.join(mixed, "token", "left_semi"), "apart")

    left = apart()
    chosen = [F.min_by(F.struct("rep", "comp", "n", "i"), F.xxhash64("token", "rep", F.lit(seed))) for seed in range(LEADERS)]
    lead = left.groupBy("token").agg(F.array_distinct(F.array(*chosen)).alias("leads")).select("token", F.explode("leads").alias("lead"))
    stars = left.join(lead, "token").filter((F.col("comp") != F.col("lead.comp")) & may_link(F.col("n"), F.col("lead.n"), F.col("i"), F.col("lead.i"), percent))
    pairs = stars.select(F.least("rep", "lead.rep").alias("x"), F.greatest("rep", "lead.rep").alias("y")).distinct()
    comps = relabelled(comps, verified(pruned(written(pairs, "pairs"), nodes, percent), source, size, percent))

    # Last round: all pairs whose components still differ.
    left = apart()
    pairs = within_lists(left, percent).distinct()
    comps = relabelled(comps, verified(pruned(written(pairs, "pairs"), nodes, percent), source, size, percent))

    labelled = copies.select("fp", "rep").join(comps, "rep", "left").select("fp", F.coalesce("comp", "rep").alias("comp"))
    found = slim.select("doc_id", "n", "fp").join(labelled, "fp", "left")
    return found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("comp")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: one with its smallest id, null ids last. All rows without words stay.

    Ids only name rows where each is one row's; else rows are numbered and linked by their number, so neither null nor repeated ids tie texts together."""
    if names_rows(docs, doc_id):
        kept = join(docs, doc_id, text).filter(F.col(doc_id) == F.col("component_id")).select(F.col(doc_id).alias(KEPT))
        return docs.join(kept, F.col(doc_id) == F.col(KEPT), "left_semi")
    # The choice among rows of one id goes by their texts, so it doesn't hang on how rows lie.
    rank = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.xxhash64(text).alias("of"), F.col(ROW).alias("row"))
    rows = written(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")
    found = join(rows.select(F.col(ROW).alias("row"), F.col(text).alias("text")), "row", "text")
    ranked = rows.select(F.col(ROW).alias("row"), rank.alias("rank")).join(found, "row").filter("n_shingles > 0")
    first = ranked.groupBy("component_id").agg(F.min_by("row", "rank").alias(KEPT)).select(KEPT)
    stay = first.unionByName(found.filter("n_shingles = 0").select(F.col("row").alias(KEPT)))
    return rows.join(stay, F.col(ROW) == F.col(KEPT), "left_semi").drop(ROW)
