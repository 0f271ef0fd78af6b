"""Direction patterns: letters, run-length compression, edit distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def letters(c: Column, alphabet: str = "RHDV") -> Column:
    """The pattern's letters in upper case, whatever stands between them; '' for NULL."""
    return F.coalesce(F.array_join(F.regexp_extract_all(F.upper(c), F.lit(f"([{alphabet}])"), F.lit(1)), ""), F.lit(""))


def compressed(c: Column) -> Column:
    """Repeats of a letter collapsed."""
    return F.regexp_replace(letters(c), r"(.)\1+", "$1")


def structural_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length of two compressed patterns; 0 if either is empty."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(1 - F.levenshtein(a, b) / longer)
