"""Text helpers as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalised(text: Column) -> Column:
    """A name as it is compared: runs of white space, underscores and hyphens are one space, in lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"[\s_\-]+", " ")))


def digest(text: Column) -> Column:
    """Identity of a query text, whatever its white space."""
    return F.sha1(F.trim(F.regexp_replace(text, r"\s+", " ")).cast("binary"))


def after(text: Column, separator: str) -> Column:
    """What follows the first separator; empty if there is none."""
    at = F.instr(text, separator)
    return F.when(at > 0, F.substring(text, at + len(separator), F.length(text))).otherwise(F.lit(""))


def joined(values: Column, separator: str = ", ") -> Column:
    """Distinct values of a group in order, as one string; empty for a group without values."""
    return F.array_join(F.array_sort(F.collect_set(values)), separator)


def word_prefix(word: str) -> str:
    """Pattern that finds a word beginning with the given letters."""
    return r"\b" + re.escape(word)
