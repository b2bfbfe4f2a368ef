"""The registered queries of the operators: thin layers that apply each to its whole table."""

from __future__ import annotations

import uuid
from secrets import token_hex

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import bpe, collocations, decontaminate, fingerprints, jaccard, langid, lexical, quality, secrets, sharding, suffix_dedup, surrogates, topk
from scriptorium.llm.support import deleted_at_exit, shared_folder


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(spark: SparkSession, name: str = "byte_bpe_50k.tiktoken") -> bpe.Ranks:
    import public_tokenizers

    return bpe.Ranks(spark, public_tokenizers.path(name), public_tokenizers.PATTERN)


def ledger(spark: SparkSession) -> str:
    """The session's lasting ledger of secret scans; without one, a new one that goes when the driver ends."""
    new = lambda: deleted_at_exit(spark, f"{shared_folder(spark)}/{spark.sparkContext.applicationId}-ledger-{uuid.uuid4().hex[:12]}")
    return spark.conf.get("spark.scriptorium.secrets.ledger", None) or new()


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(read(spark, sf_dir, "documents"), ledger(spark), path="doc_id"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), each_item=False))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(read(spark, sf_dir, "documents"), limit=sharding.QUERY_BYTES)


def op5_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.dedup(read(spark, sf_dir, "documents")))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(read(spark, sf_dir, "documents"))


def round_trip(docs: DataFrame, ranks: bpe.Ranks, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids of each text and the bytes they decode to, as digests."""
    back = bpe.encode(docs.select(doc_id, text), ranks, text=text, drop=(text,), decoded="decoded")
    numbers = F.array_join(F.transform("ids", lambda x: x.cast("string")), " ")
    return back.select(doc_id, F.size("ids").cast("long").alias("n_tokens"), F.sha2(numbers.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "documents"), tokenizer(spark))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"), langid.default_vocabulary())


def op9_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the session's own key; without one, with a key that is forgotten after the run."""
    key = spark.conf.get("spark.scriptorium.surrogates.key", None) or token_hex(32)
    return surrogates.replace(read(spark, sf_dir, "documents"), key)


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.digest(fingerprints.edited(read(spark, sf_dir, "documents")))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_decontaminate": op2_decontaminate,
    "op3_quality": op3_quality,
    "op4_sharding": op4_sharding,
    "op5_suffix": op5_suffix,
    "op6_jaccard": op6_jaccard,
    "op7_bpe": op7_bpe,
    "op8_language": op8_language,
    "op9_surrogates": op9_surrogates,
    "op10_topk": op10_topk,
    "op11_fingerprints": op11_fingerprints,
    "op12_collocations": op12_collocations,
    "op13_lexical": op13_lexical,
}
