"""Schemas of the tables that sources read and sinks write. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "map<string,string>": T.MapType(T.StringType(), T.StringType())}


def _struct(text: str) -> T.StructType:
    """A schema from "name type, ..."; Spark's own parser would need a session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (part.split() for part in text.split(", "))])


PAGE_INVENTORY = _struct("book_id string, page_id string, image_path string, text_path string, image_bytes bigint, text_bytes bigint, image_width int, image_height int")
MISMATCH = _struct("timestamp string, book_id string, page_id string, path string, reason string")
QUALITY_TAG = _struct("browse_index int, book_id string, page_id string, image_path string, text_path string, image_bytes bigint, image_height int, quality_bucket string, has_latin_chars boolean")
EVAL_SUBSET = _struct("book_id string, page_id string, quality_bucket string, has_latin_chars boolean, image_path string, text_path string")
TRANSCRIPTION = _struct("book_id string, page_id string, model string, preprocessing string, text string")
MANIFEST = _struct("page_id string, book_id string, model string, latency_ms double, text_length int, skipped boolean, error string")
SCORE = _struct("book_id string, page_id string, model string, preprocessing string, cer double, wer double")
FLUENCY = _struct("book_id string, page_id string, model string, preprocessing string, fluency_rating int, fluency_reason string, latency_ms double, judge_model string")
ERROR_CATEGORY = _struct("model string, preprocessing string, category string, count bigint, n_pages bigint")
CORRELATION = _struct("metric string, value double")
OCR_RESULT = _struct("text string, model_name string, latency_ms double, raw_response map<string,string>")
LOG_LINE = _struct("timestamp string, level string, logger string, message string, extras map<string,string>")

PAGE_KEYS = ("book_id", "page_id")
CELL_KEYS = ("model", "preprocessing")
SCORE_KEYS = (*PAGE_KEYS, *CELL_KEYS)
