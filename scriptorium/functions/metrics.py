"""Edit-distance metrics, gestalt similarity and the edit classifier."""

from __future__ import annotations

import unicodedata
from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.functions.distance import sequence_distance, text_distance
from scriptorium.functions.text import nfc

#: Categories in their order, and the length from which an edit is a burst.
CATEGORIES = ("vowel_sign", "conjunct", "base_consonant_vowel", "whitespace", "latin_punctuation", "hallucination_burst", "omission_burst", "other")
BURST = 8


def cer_of(ref: Column, hyp: Column) -> Column:
    """Edits over the reference's length; both are NFC. An empty reference fails the query, an empty hypothesis is 1.0, and nothing is clamped."""
    edits = text_distance(ref, hyp)
    return F.when(ref == "", F.raise_error(F.lit("reference must not be empty")).cast("double")).when(hyp == "", 1.0).otherwise(edits / F.length(ref))


def cer(ref: Column, hyp: Column) -> Column:
    return cer_of(nfc(ref), nfc(hyp))


def words(text: Column, tokenizer: str = "whitespace") -> Column:
    """Words between white space, or with ``single_space`` what single spaces part after runs of white space have become one space."""
    if tokenizer == "whitespace":
        return F.filter(F.split(text, r"\s+"), lambda w: w != "")
    if tokenizer == "single_space":
        return F.filter(F.split(F.trim(F.regexp_replace(text, r"\s{2,}", " ")), " "), lambda w: w != "")
    raise ValueError(f"unknown tokenizer {tokenizer!r}")


def wer_of(ref: Column, hyp: Column, tokenizer: str = "whitespace") -> Column:
    """Word edits over the reference's words; both are NFC. A reference without words fails the query."""
    r, h = words(ref, tokenizer), words(hyp, tokenizer)
    return F.when(F.size(r) == 0, F.raise_error(F.lit("reference has no words")).cast("double")).when(F.size(h) == 0, 1.0).otherwise(sequence_distance(r, h) / F.size(r))


def wer(ref: Column, hyp: Column, tokenizer: str = "whitespace") -> Column:
    return wer_of(nfc(ref), nfc(hyp), tokenizer)


def gestalt(a: str, b: str) -> float:
    """2 M / T by longest matching blocks, with the popularity rule for second texts of 200 characters or more. Not symmetric."""
    a, b = unicodedata.normalize("NFC", a), unicodedata.normalize("NFC", b)
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    return SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(T.DoubleType())
def agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    """Gestalt similarity of pairs in their order; null if either is."""
    return pd.Series([None if x is None or y is None else gestalt(x, y) for x, y in zip(a, b)], dtype="Float64")


def classify(text: str) -> str:
    """The category of edited characters, as ``functions.text.edit_class`` has it."""
    if not text:
        return "other"
    if text.isspace():
        return "whitespace"
    codes = [ord(c) for c in text]
    if 0x0C4D in codes:
        return "conjunct"
    if any(0x0C3E <= c < 0x0C4D for c in codes):
        return "vowel_sign"
    if any(0x0C00 <= c <= 0x0C7F for c in codes):
        return "base_consonant_vowel"
    if any("!" <= c <= "~" or unicodedata.category(c)[0] == "P" or "LATIN" in unicodedata.name(c, "") for c in text):
        return "latin_punctuation"
    return "other"


def edit_units(ref: str, hyp: str, burst: int = BURST) -> dict[str, int]:
    """Units of each category between two texts. A side of ``burst`` characters or more is one event; any other edit counts its longer side in characters, and a short side beside a burst counts nothing."""
    ref, hyp = unicodedata.normalize("NFC", ref), unicodedata.normalize("NFC", hyp)
    units: Counter[str] = Counter()
    for kind, i, j, k, m in SequenceMatcher(None, ref, hyp, autojunk=False).get_opcodes() if ref else ():
        if kind == "equal":
            continue
        gone, came = ref[i:j], hyp[k:m]
        bursts = [name for name, side in (("omission_burst", gone), ("hallucination_burst", came)) if len(side) >= burst]
        if bursts:
            units.update(bursts)
        else:
            units[classify(gone + came)] += max(len(gone), len(came))
    return dict(units)


def edit_categories(burst: int = BURST):
    """A pandas UDF from (reference, hypothesis) to a map of units by category; empty for an empty reference."""

    @F.pandas_udf(T.MapType(T.StringType(), T.IntegerType()))
    def run(ref: pd.Series, hyp: pd.Series) -> pd.Series:
        return pd.Series([None if r is None or h is None else edit_units(r, h, burst) for r, h in zip(ref, hyp)])

    return run
