"""Whitespace-aware string expressions shared by cleaning, header discovery
and text entities. Whitespace is the ASCII set Python's ``str.split`` and
``str.strip`` use for ASCII text: space, tab, LF, CR, FF, VT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS_CLASS = r"[ \t\n\r\f\x0B]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


WS_CHARS = " \t\n\r\f\x0b"


def py_strip(col) -> Column:
    """``str.strip()`` for ASCII whitespace (plain ``trim`` only removes
    spaces). ``btrim`` with a character set: no regular expression, codegen."""
    return F.btrim(_c(col), F.lit(WS_CHARS))


def blank_to_null(col) -> Column:
    """Stripped value, or NULL when nothing is left."""
    s = py_strip(col)
    return F.when(s == "", F.lit(None).cast("string")).otherwise(s)


def words(col) -> Column:
    """``str.split()`` tokens as an array (no empty strings). The text is
    stripped first, so splitting on whitespace runs yields no empty token -
    no lambda, so the expression stays in whole-stage codegen."""
    stripped = py_strip(col)
    return F.when(stripped == "", F.array().cast("array<string>")).otherwise(
        F.split(stripped, rf"{WS_CLASS}+"))


def word_count(col) -> Column:
    return F.size(words(col)).cast("bigint")


def lines(col) -> Column:
    """Physical lines split at LF (a trailing LF gives a final empty line)."""
    return F.split(_c(col), "\n", -1)


def line_count(col) -> Column:
    return F.size(lines(col)).cast("bigint")


def first_line(col) -> Column:
    return F.substring_index(_c(col), "\n", 1)
