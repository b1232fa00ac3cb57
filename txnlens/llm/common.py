"""Expressions that several text operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What separates words, and what a word is.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once however often the body (or a lambda in it) reads it."""
    return F.transform(F.array(value), body)[0]


def text_of(df: DataFrame, name: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(df[name].cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def chars_in(text: Column, char_class: str) -> Column:
    """Number of characters of a class such as ``A-Z``."""
    return F.length(F.regexp_replace(text, f"[^{char_class}]+", ""))


def held_out(doc_id: Column) -> Column:
    """The fifth of all documents that nothing is learnt from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
