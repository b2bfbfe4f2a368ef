"""Text normalisation, script tests and path helpers as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The script block that pages are expected in, and the refusal limit.
SCRIPT_BLOCK = (0x0C00, 0x0C7F)
REFUSAL_MAX_CHARS = 30
#: Media types by extension.
MEDIA_TYPES = {".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png"}
#: White space as Python's str.strip() has it, for Java's regular expressions.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"


#: Characters or words of an Arrow batch that are worked on at a time, whatever the batch's size.
ITEMS = 1 << 22


def parts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(start, stop) of runs of rows whose sizes are ``most`` at most together, or of single rows."""
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(ends, most + (ends[start - 1] if start else 0), side="right")))
        yield start, stop
        start = stop


@F.arrow_udf(T.StringType())
def nfc(text: pa.Array) -> pa.Array:
    """NFC form. Texts that are ASCII are NFC already and stay as they are."""
    if not len(text) or pc.all(pc.string_is_ascii(text), skip_nulls=True).as_py() is not False:
        return text
    normal = lambda some: pa.array([t if t is None or t.isascii() else unicodedata.normalize("NFC", t) for t in some.to_pylist()], text.type)
    sizes = pc.binary_length(text).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return pa.concat_arrays([normal(text.slice(start, stop - start)) for start, stop in parts(sizes, ITEMS)])


def is_nfc(text: Column) -> Column:
    return text == nfc(text)


def strip(text: Column) -> Column:
    """Without white space at either end (SQL's trim only takes spaces)."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def ascii_fold(text: Column) -> Column:
    """Every character outside the printable ASCII range becomes a question mark."""
    return F.regexp_replace(text, "[^ -~]", "?")


def model_of_cell(cell: Column) -> Column:
    """Up to the first underscore; the whole name if there is none."""
    return F.substring_index(cell, "_", 1)


def preprocessing_of_cell(cell: Column) -> Column:
    """After the first underscore; ``unknown`` if there is none."""
    return F.when(F.instr(cell, "_") == 0, "unknown").otherwise(F.substring(cell, F.instr(cell, "_") + 1, F.length(cell)))


def has_script(text: Column, block: tuple[int, int] = SCRIPT_BLOCK) -> Column:
    """Any code point of the block."""
    return text.rlike(f"[\\x{{{block[0]:X}}}-\\x{{{block[1]:X}}}]")


def is_refusal(text: Column, block: tuple[int, int] = SCRIPT_BLOCK, limit: int = REFUSAL_MAX_CHARS) -> Column:
    """A short answer (1 to limit - 1 characters once stripped) without the script."""
    return F.length(strip(text)).between(1, limit - 1) & ~has_script(text, block)


def model_output(text: Column, block: tuple[int, int] = SCRIPT_BLOCK, limit: int = REFUSAL_MAX_CHARS) -> Column:
    """What an adapter keeps of an answer: nothing of blank ones and refusals, else the text."""
    return F.when(F.coalesce(strip(text), F.lit("")) == "", "").when(is_refusal(text, block, limit), "").otherwise(text)


def valid_utf8(content: Column) -> Column:
    """The text of bytes that are UTF-8, else null; the error is data, not a failure."""
    return F.try_validate_utf8(content.cast("string"))


def preview(text: Column, chars: int = 30) -> Column:
    return F.substring(text, 1, chars)


def relative_to(path: Column, root: str) -> Column:
    """Relative to ``root``, or as it is if it lies elsewhere."""
    base = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(base)), F.substring(path, F.lit(len(base) + 1), F.length(path))).otherwise(path)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def with_suffix(path: Column, suffix: str) -> Column:
    return F.concat(F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", ""), F.lit(suffix))


def media_type(path: Column) -> Column:
    """By extension in either case; another extension fails the query."""
    extension = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    out = F.raise_error(F.concat(F.lit("unsupported image extension: "), extension)).cast("string")
    for ending, kind in MEDIA_TYPES.items():
        out = F.when(extension == ending, kind).otherwise(out)
    return out


def format_bytes(n: Column) -> Column:
    """Whole units by floor division at each step, with one decimal that is always 0."""
    rungs = [("B", 1), ("KB", 1 << 10), ("MB", 1 << 20), ("GB", 1 << 30), ("TB", 1 << 40)]
    out = F.format_string("%d.0 %s", F.floor(n / F.lit(rungs[-1][1])), F.lit(rungs[-1][0]))
    for (unit, size), (_, above) in list(zip(rungs, rungs[1:]))[::-1]:
        out = F.when(n < above, F.format_string("%d.0 %s", F.floor(n / F.lit(size)), F.lit(unit))).otherwise(out)
    return out


def strip_dots(name: Column) -> Column:
    """Without all leading dots."""
    return F.regexp_replace(name, r"^\.+", "")


def code_point_class(char: Column, block: tuple[int, int] = SCRIPT_BLOCK) -> Column:
    """vowel_sign, virama, base, latin_or_punctuation, space or other, of a single character."""
    return (
        F.when(char.rlike(r"^\x{0C4D}$"), "virama")
        .when(char.rlike(r"^[\x{0C3E}-\x{0C4C}]$"), "vowel_sign")
        .when(has_script(char, block), "base")
        .when(char.rlike(f"^{SPACE}$"), "space")
        .when(char.rlike(r"^[\p{IsLatin}\p{P}!-~]$"), "latin_or_punctuation")
        .otherwise("other")
    )


def edit_class(text: Column, block: tuple[int, int] = SCRIPT_BLOCK) -> Column:
    """Category of edited characters: white space only, then conjunct, vowel sign, base, Latin or punctuation, other."""
    low, high = f"\\x{{{block[0]:X}}}", f"\\x{{{block[1]:X}}}"
    return (
        F.when(text.isNull() | (text == ""), "other")
        .when(text.rlike(f"^{SPACE}+$"), "whitespace")
        .when(text.rlike(r"\x{0C4D}"), "conjunct")
        .when(text.rlike(r"[\x{0C3E}-\x{0C4C}]"), "vowel_sign")
        .when(text.rlike(f"[{low}-{high}]"), "base_consonant_vowel")
        .when(text.rlike(r"[\p{IsLatin}\p{P}!-~]"), "latin_punctuation")
        .otherwise("other")
    )


def prompt(template: str, **values: Column) -> Column:
    """A template with {name} holes; doubled braces are braces."""
    out, rest = [], template
    while rest:
        at = min((i for i in (rest.find("{"), rest.find("}")) if i >= 0), default=-1)
        if at < 0:
            out.append(F.lit(rest))
            break
        out.append(F.lit(rest[:at]))
        if rest[at : at + 2] in ("{{", "}}"):
            out.append(F.lit(rest[at]))
            rest = rest[at + 2 :]
        elif rest[at] == "{":
            name, rest = rest[at + 1 :].split("}", 1)
            out.append(values[name])
        else:
            raise ValueError("single } in template")
    return F.concat(*out) if out else F.lit("")


def joined_blocks(blocks: Column, kind: str = "text") -> Column:
    """The texts of a response's blocks (type, text) of one type, one after the other."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == kind), lambda b: b["text"]), "")


def base64_line(content: Column) -> Column:
    """Base64 without the line breaks that Spark puts after every 76 characters."""
    return F.replace(F.base64(content), F.lit("\r\n"), F.lit(""))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
