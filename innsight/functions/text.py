"""Name matching and display text."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

EM_DASH = "—"


_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase


def _folded(term: str) -> str:
    return term.translate(str.maketrans(_UPPER, _LOWER))


def like_pattern(term: str) -> str:
    """``%term%`` for a case-insensitive substring match, A-Z in lower case.

    The term is bound as-is: ``%`` and ``_`` inside it stay wildcards, as in a
    LIKE pattern without an ESCAPE clause.  Spark's LIKE uses ``\\`` as its
    escape character, so every backslash is doubled to keep it literal.
    """
    return "%" + _folded(term).replace("\\", "\\\\") + "%"


def contains_ci(col: Column, term: str) -> Column:
    """``col LIKE '%term%'`` that takes A-Z and a-z as equal and folds nothing else.

    The optimizer makes a plain ``Contains`` of a term without wildcards."""
    folded = F.translate(col, _UPPER, _LOWER)
    return folded.like(like_pattern(term))


def full_name(first: Column | str, last: Column | str) -> Column:
    """``first || ' ' || last``: NULL when either part is NULL (``concat_ws``
    would skip the NULL instead)."""
    first = F.col(first) if isinstance(first, str) else first
    last = F.col(last) if isinstance(last, str) else last
    return F.concat(first, F.lit(" "), last)


def name_matches(first: Column | str, last: Column | str, term: str) -> Column:
    """Three-way OR: first name, last name or full name contains ``term``."""
    first = F.col(first) if isinstance(first, str) else first
    last = F.col(last) if isinstance(last, str) else last
    return contains_ci(first, term) | contains_ci(last, term) | contains_ci(full_name(first, last), term)


def dash_if_blank(col: Column) -> Column:
    """NULL or empty text shown as an em dash."""
    text = col.cast("string")
    return F.when(text.isNull() | (text == ""), F.lit(EM_DASH)).otherwise(text)
