"""Normalisation of keys and free text, all inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANKS = r"[\s\u00a0\u2000-\u200b\u3000\ufeff]+"
_BRACES = r"[\s{}\u00a0\u2000-\u200b\u3000\ufeff]+"


def norm_text(c: Column) -> Column:
    """NULL becomes the empty string, outer blanks go."""
    return F.coalesce(F.trim(c), F.lit(""))


def first_filled(*cols: Column) -> Column:
    """First value that is neither NULL nor blank, trimmed; NULL if there is none."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cols])


def norm_equipment_key(c: Column) -> Column:
    """Upper case, no white space, no trailing ``-`` or ``_``."""
    return F.regexp_replace(F.regexp_replace(F.upper(c), r"[\s 　]+", ""), r"[-_]+$", "")


def norm_guid(c: Column) -> Column:
    """Lower-case 8-4-4-4-12 form without braces and blanks; NULL for NULL or blank.

    Text that is not made of 32 hexadecimal digits is kept, lower-cased and stripped, so that
    it can still be compared with itself.
    """
    bare = F.regexp_replace(F.lower(c), r"[\s{} ]+", "")
    digits = F.regexp_replace(bare, "-", "")
    dashed = F.regexp_replace(
        digits, r"^([0-9a-f]{8})([0-9a-f]{4})([0-9a-f]{4})([0-9a-f]{4})([0-9a-f]{12})$", "$1-$2-$3-$4-$5"
    )
    return F.nullif(F.when(digits.rlike("^[0-9a-f]{32}$"), dashed).otherwise(bare), F.lit(""))
