"""Word sets of a text as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is taken out before words are read, and what a word is.
IMAGE_TAG = r"(?s)<img>.*?</img>"
ANY_TAG = r"<[^>]*>"
WORD = r"[\p{L}\p{N}]+"


def without_tags(text: Column) -> Column:
    """``text`` in lower case without ``<img>…</img>`` (content included) and any other ``<…>`` tag."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), IMAGE_TAG, " "), ANY_TAG, " ")


def all_words(text: Column) -> Column:
    """The lower-case runs of letters and digits of ``text`` in order; null gives an empty array."""
    return F.regexp_extract_all(F.coalesce(without_tags(text), F.lit("")), F.lit(WORD), F.lit(0))


def words(text: Column) -> Column:
    """The distinct :func:`all_words` of ``text``."""
    return F.array_distinct(all_words(text))


def word_hashes(text: Column, *salt: Column) -> Column:
    """:func:`words` as 64-bit hashes, each together with ``salt``."""
    return F.array_distinct(F.transform(all_words(text), lambda w: F.xxhash64(w, *salt)))
