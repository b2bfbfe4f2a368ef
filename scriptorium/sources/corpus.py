"""Corpus trees as tables: <root>/<book>/<page>.{jpg,png,txt}."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium import schemas
from scriptorium.functions.text import is_nfc, preview, valid_utf8
from scriptorium.operators.pairing import pair
from scriptorium.operators.sampling import spot_check
from scriptorium.sources import headers
from scriptorium.sources.headers import IMAGE_EXTENSIONS, TEXT_EXTENSION

def files(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """(path, relative, book_id, page_id, extension, length): files below the books of ``root``. Hidden folders and files at the root don't count. Without ``content``, none is read. A root that doesn't exist fails."""
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), r"^file:/*", "/")
    plain = F.regexp_replace("path", r"^file:/*", "/")
    relative = F.when(F.startswith(plain, F.concat(base, F.lit("/"))), F.substring(plain, F.length(base) + 2, F.length(plain))).otherwise(plain)
    listed = scan.select("path", relative.alias("relative"), "length", *(["content"] if content else []))
    name = F.element_at(F.split("relative", "/"), -1)
    keyed = listed.withColumn("book_id", F.substring_index("relative", "/", 1)).withColumn("page_id", F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")).withColumn("extension", F.lower(F.regexp_extract(name, r"(?<=.)(\.[^.]*)$", 1)))
    return keyed.filter(F.contains(F.col("relative"), F.lit("/")) & ~F.col("relative").rlike(r"(^|/)\.[^/]"))


def inventory(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Pages with both files (``PAGE_INVENTORY``), and what doesn't pair or can't be read (``MISMATCH``). Of several images of a page the first by path counts."""
    found = headers.scan(spark, root)
    size = F.when(F.col("width").isNotNull(), F.struct("width", "height"))
    images = found.filter(F.col("extension").isin(*IMAGE_EXTENSIONS)).select("book_id", "page_id", F.col("relative").alias("image_path"), F.col("length").alias("image_bytes"), size.alias("size"))
    first = images.groupBy("book_id", "page_id").agg(F.min(F.struct("image_path", "image_bytes", "size")).alias("i")).select("book_id", "page_id", "i.*")
    texts = found.filter(F.col("extension") == TEXT_EXTENSION).select("book_id", "page_id", F.col("relative").alias("text_path"), F.col("length").alias("text_bytes"))
    every = pair(first, texts).withColumn("reason", F.when(F.col("reason").isNull() & F.col("size.width").isNull(), "image_unreadable: no PNG or JPEG header").otherwise(F.col("reason")))
    names = [f.name for f in schemas.PAGE_INVENTORY.fields]
    rows = every.filter("reason is null").select("book_id", "page_id", "image_path", "text_path", "image_bytes", "text_bytes", F.col("size.width").alias("image_width"), F.col("size.height").alias("image_height")).select(*names)
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    bad = every.filter("reason is not null").select(now.alias("timestamp"), "book_id", "page_id", F.coalesce("image_path", "text_path").alias("path"), "reason")
    return rows, bad


def discover_books(spark: SparkSession, root: str, extensions: tuple[str, ...] = IMAGE_EXTENSIONS) -> DataFrame:
    """(book_id, paths): sorted images of each top folder, at any depth; those at the root are of the book '.'."""
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), r"^file:/*", "/")
    plain = F.regexp_replace("path", r"^file:/*", "/")
    relative = F.substring(plain, F.length(base) + 2, F.length(plain))
    images = scan.select(relative.alias("r")).filter(F.lower("r").rlike("(" + "|".join(e.replace(".", r"\.") for e in extensions) + ")$"))
    book = F.when(F.contains(F.col("r"), F.lit("/")), F.substring_index("r", "/", 1)).otherwise(".")
    return images.groupBy(book.alias("book_id")).agg(F.array_sort(F.collect_list("r")).alias("paths")).orderBy("book_id")


def transcriptions(spark: SparkSession, root: str) -> DataFrame:
    """(cell, book_id, page_id, text) of <root>/<cell>/.../<book>/<page>.txt."""
    read = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    base = F.regexp_replace(F.lit(root.rstrip("/")), r"^file:/*", "/")
    plain = F.regexp_replace(F.url_decode("path"), r"^file:/*", "/")
    parts = F.split(F.substring(plain, F.length(base) + 2, F.length(plain)), "/")
    return read.select(parts[0].alias("cell"), F.element_at(parts, -2).alias("book_id"), F.regexp_replace(F.element_at(parts, -1), r"\.txt$", "").alias("page_id"), "text")


def csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV file with a header and a declared schema; blank fields are null, and a missing file fails."""
    return spark.read.schema(schema).option("header", "true").option("enforceSchema", "false").option("mode", "FAILFAST").csv(path)


def finished_keys(spark: SparkSession, path: str, schema: T.StructType, keys: tuple[str, ...] = schemas.SCORE_KEYS) -> DataFrame:
    """The keys that a sink already holds; none if there is no sink yet."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], T.StructType([schema[k] for k in keys]))
    return csv(spark, path, schema).select(*keys).distinct()


def encoding_check(spark: SparkSession, root: str, n: int = 20, seed: int = 42) -> DataFrame:
    """(relative, valid_utf8, is_nfc, n_chars, preview) of ``n`` text files."""
    read = spot_check(files(spark, root).filter(F.col("extension") == TEXT_EXTENSION).select("relative"), ["relative"], n, seed)
    content = files(spark, root, content=True).filter(F.col("extension") == TEXT_EXTENSION).select("relative", "content")
    text = valid_utf8(F.col("content"))
    return content.join(read, "relative", "left_semi").select("relative", text.isNotNull().alias("valid_utf8"), is_nfc(text).alias("is_nfc"), F.length(text).alias("n_chars"), preview(text).alias("preview"))


def top_folders(paths: DataFrame, path: str = "path") -> DataFrame:
    """Distinct first parts of listed paths that have one."""
    return paths.filter(F.contains(F.col(path), F.lit("/"))).select(F.split_part(F.col(path), F.lit("/"), F.lit(1)).alias("folder")).distinct()


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON log lines: the reserved keys as columns, all else in ``extras``."""
    from scriptorium.operators.logs import RESERVED, extras_of

    record = F.from_json("value", "map<string,string>")
    lines = spark.read.text(path).select(record.alias("r")).filter("r is not null")
    return lines.select(*(F.element_at("r", k).alias(k) for k in RESERVED), extras_of(F.col("r")).alias("extras"))


def unit(column: Column, size: int = 1024) -> Column:
    return column / size
