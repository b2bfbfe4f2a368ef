"""Strict parsing of a judge's JSON answers: a value or a distinct error, never a default."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.text import strip

FENCE = "```"


def without_fences(text: Column) -> Column:
    """Every line that starts with three backticks goes, if the text itself starts with them."""
    inner = strip(text)
    lines = F.filter(F.split(inner, r"\r\n|\r|\n"), lambda line: ~F.startswith(line, F.lit(FENCE)))
    return F.when(F.startswith(inner, F.lit(FENCE)), strip(F.array_join(lines, "\n"))).otherwise(inner)


def parse(answer: Column) -> Column:
    """struct<rating, reason, error_examples, error>: either the first three or an error.

    The rating must be a JSON integer from 1 to 5; true, 3.0 and "3" are not."""
    body = F.try_parse_json(without_fences(answer))
    kind = lambda path: F.schema_of_variant(F.try_variant_get(body, path, "variant"))
    shape, rating = F.schema_of_variant(body), F.try_variant_get(body, "$.rating", "int")
    reason, examples = kind("$.reason"), kind("$.error_examples")
    missing = lambda k: k.isNull()
    error = (
        F.when(answer.isNull() | body.isNull(), "not valid JSON")
        .when(~F.startswith(shape, F.lit("OBJECT")), "not an object")
        .when(missing(kind("$.rating")), "missing rating")
        .when((kind("$.rating") != "BIGINT") | ~F.coalesce(rating.between(1, 5), F.lit(False)), "rating must be an integer 1-5")
        .when(~missing(reason) & (reason != "STRING"), "reason must be a string")
        .when(~missing(examples) & ~F.startswith(examples, F.lit("ARRAY")), "error_examples must be a list")
    )
    listed = F.try_variant_get(body, "$.error_examples", "array<string>")
    good = lambda c: F.when(error.isNull(), c)
    return F.struct(
        good(rating).alias("rating"),
        good(F.coalesce(F.try_variant_get(body, "$.reason", "string"), F.lit(""))).alias("reason"),
        good(F.coalesce(listed, F.array().cast("array<string>"))).alias("error_examples"),
        error.alias("error"),
    )
