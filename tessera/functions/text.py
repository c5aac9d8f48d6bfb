"""Column builders for text: tokens, sentences, normalisation, pattern predicates."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Sentinels that count as missing text and the patterns of the text features.
MISSING = ("", "nan", "none", "null", "n/a", "na")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SENTENCE_BREAK = r"(?<=[.!?])\s+(?=[A-Z0-9])"
BEYOND_ASCII = r"[^\x00-\x7F\P{L}]|[^\x00-\x7F\P{N}]"


def is_empty_text(text: Column) -> Column:
    """Null, blank or a literal sentinel for a missing value."""
    return text.isNull() | F.lower(F.trim(text)).isin(*MISSING)


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def question_key(text: Column) -> Column:
    return F.lower(collapse_spaces(F.coalesce(text, F.lit(""))))


def unicode_form(text: Column, form: str = "NFC") -> Column:
    """Text in a Unicode normal form, by Arrow batches (there is no built-in)."""

    def work(values: pd.Series) -> pd.Series:
        return values.map(lambda t: None if t is None else unicodedata.normalize(form, t))

    return F.pandas_udf(work, "string")(text)


def normalize_text(text: Column) -> Column:
    """Line ends to \\n, tabs to spaces, runs of spaces to one, stripped lines, at most one blank line, trimmed."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    t = F.regexp_replace(F.regexp_replace(t, r"\t", " "), " +", " ")
    t = F.regexp_replace(F.regexp_replace(t, r" ?\n ?", "\n"), r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """White-space tokens."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\S+"), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """Lower case of A-Z only, which keeps what the token patterns match."""
    return F.translate(text, UPPER, UPPER.lower())


def search_tokens(text: Column) -> Column:
    """Lower-cased search tokens of two or more characters."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9][a-z0-9\-]+"), F.lit(0))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), SENTENCE_BREAK), lambda s: F.trim(s)), lambda s: s != "")


def content_words(text: Column, stop: tuple[str, ...]) -> Column:
    """Distinct search tokens that are no stop words."""
    return F.array_distinct(F.filter(search_tokens(text), lambda w: ~w.isin(*stop)))


def word_edges(text: Column) -> Column:
    """The text with letters and digits beyond ASCII as underscores, so that `\\b` means the same to every engine."""
    return F.regexp_replace(text, BEYOND_ASCII, "_")


def bigrams(words: Column) -> Column:
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
