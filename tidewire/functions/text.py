"""Text functions as column expressions; one Arrow function where normalisation has no built-in form."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points that cleaning removes, and those it reads as a space.
REMOVED_POINTS = [*range(0, 9), 11, 12, *range(14, 32), 127, 0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF]
SPACE_POINTS = [0x00A0, 0x202F, 0x2007, 0x2028, 0x2029]
# Entities that occur in crawled pages and are decoded without leaving the JVM.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&laquo;", "«"), ("&raquo;", "»"), ("&middot;", "·"), ("&copy;", "©"), ("&mdash;", "—"), ("&ndash;", "–"), ("&amp;", "&"))
# Marks of a cut text, the length from which a text must end a sentence, and what ends one.
CUT_MARKS, FULL_LENGTH, SENTENCE_ENDS = ("...", "…"), 300, (".", "!", "?")
#: The title of an item without one.
NO_TITLE = "без заголовка"


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.btrim(text), F.lit(""))


def without_markup(text: Column) -> Column:
    """Script and style elements go with their bodies, other tags become a space."""
    for element in ("script", "style"):
        text = F.regexp_replace(text, f"(?is)<{element}[^>]*>.*?</{element}>", " ")
    return F.regexp_replace(text, r"<[^>]+>", " ")


def decoded_entities(text: Column) -> Column:
    for entity, plain in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def one_spaced(text: Column) -> Column:
    """Runs of white space become one space; a text of nothing else is null."""
    return blank_to_null(F.regexp_replace(text, r"(?U)\s+", " "))


def clean(text: Column) -> Column:
    """Markup, entities, control and invisible characters and spare white space removed, without leaving the JVM.

    ``clean_full`` adds compatibility normalisation and all entities, in Arrow batches.
    """
    text = decoded_entities(without_markup(text))
    gone = "".join(map(chr, REMOVED_POINTS))
    spaces = "".join(map(chr, SPACE_POINTS))
    return one_spaced(F.translate(text, spaces + gone, " " * len(spaces)))


_TABLE = {p: None for p in REMOVED_POINTS} | {p: " " for p in SPACE_POINTS}
_ELEMENT, _TAG, _WHITE = re.compile(r"<(script|style)[^>]*>.*?</\1>", re.I | re.S), re.compile(r"<[^>]+>"), re.compile(r"\s+")


def _clean_full(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        out = []
        for text in part:
            if text is not None:
                text = html.unescape(_TAG.sub(" ", _ELEMENT.sub(" ", text)))
                text = _WHITE.sub(" ", unicodedata.normalize("NFKC", text).translate(_TABLE)).strip() or None
            out.append(text)
        yield pd.Series(out, dtype=object)


def clean_full(text: Column) -> Column:
    return F.pandas_udf(_clean_full, "string")(text)


def norm(text: Column) -> Column:
    """Lower case, letters, digits and underscores only, single spaces; the empty text for null."""
    kept = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_\s]", "")
    return F.btrim(F.regexp_replace(kept, r"\s+", " "))


def looks_truncated(text: Column) -> Column:
    end = F.rtrim(text)
    marked = F.lit(False)
    for mark in CUT_MARKS:
        marked = marked | F.contains(F.right(end, F.lit(8)), F.lit(mark))
    cut = marked | ((F.length(end) >= FULL_LENGTH) & ~F.right(end, F.lit(1)).isin(*SENTENCE_ENDS))
    return F.when(F.length(text) > 0, cut).otherwise(False)


def confident(text: Column) -> Column:
    return F.coalesce((F.length(text) >= FULL_LENGTH) & ~looks_truncated(text), F.lit(False))


def chunks(text: Column, size: int = 8000, overlap: int = 500) -> Column:
    """Windows of ``size`` characters, each beginning ``size - overlap`` after the last, while text is left."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(text) - overlap - 1) / step)).cast("int"))
    return F.when(F.length(text) > 0, F.transform(starts, lambda i: F.substring(text, i * step + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def page_title(page: Column) -> Column:
    return blank_to_null(decoded_entities(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1)))


# Elements that hold no running text.
SIDE_ELEMENTS = ("script", "style", "nav", "footer", "header", "aside", "noscript")


def plain_text(page: Column) -> Column:
    for element in SIDE_ELEMENTS:
        page = F.regexp_replace(page, f"(?is)<{element}[ >].*?</{element}>", " ")
    return one_spaced(decoded_entities(F.regexp_replace(page, r"<[^>]+>", " ")))


def between(text: Column, start: str, stop: str) -> Column:
    """The text between two literal markers, trimmed; null where either is missing."""
    at = F.locate(start, text)
    rest = F.substring(text, at + len(start), F.length(text))
    end = F.locate(stop, rest)
    return F.when((at > 0) & (end > 0), F.btrim(F.substring(rest, F.lit(1), end - 1)))


def filled(value: Column) -> Column:
    """What a message shows for a value that may be missing."""
    return F.coalesce(value.cast("string"), F.lit("—"))
