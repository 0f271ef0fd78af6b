"""Pipe sizes: four grammars that disagree and are kept apart, and the nominal ladder."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The nominal size ladder (A).
LADDER = (6, 8, 10, 15, 20, 25, 32, 40, 50, 65, 80, 90, 100, 125, 150, 175, 200, 225, 250, 300, 350, 400, 450, 500, 550, 600)


#: Outer diameter in mm of a nominal size (A).
OUTER_MM = {
    15: 21.7, 20: 27.2, 25: 34.0, 32: 42.7, 40: 48.6, 50: 60.5, 65: 76.3, 80: 89.1, 100: 114.3, 125: 139.8, 150: 165.2, 200: 216.3, 250: 267.4, 300: 318.5,
}


def outer_diameter(c: Column) -> Column:
    """Outer diameter in mm: a nominal size (A) by the table, 1.3 times the number beside it; inches; else the number; 0 without one."""
    t = F.upper(F.trim(c))
    v = F.regexp_extract(t, r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    table = F.create_map(*[F.lit(x) for kv in OUTER_MM.items() for x in kv])
    known = F.coalesce(table[F.floor(v).cast("int")], v * 1.3)
    return F.when(v.isNull(), 0.0).when(t.contains("A"), known).when(t.contains("INCH") | t.contains('"'), v * 25.4).otherwise(v)


def normalize_size(c: Column) -> Column:
    """'0050 A' -> '50A'; blank -> 'UNKNOWN'; what does not match passes, upper-cased and without blanks."""
    t = F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", ""))
    m = F.regexp_extract(t, r"^0*(\d+(?:\.\d+)?)([A-Z]*)$", 1)
    return F.when(t == "", "UNKNOWN").when(m != "", F.concat(m, F.regexp_extract(t, r"^0*(\d+(?:\.\d+)?)([A-Z]*)$", 2))).otherwise(t)


def first_number(c: Column) -> Column:
    """First number after DN and MM are dropped, else NULL."""
    t = F.regexp_replace(F.upper(c), "DN|MM", "")
    return F.regexp_extract(t, r"(\d+(?:\.\d+)?)", 1).try_cast("double")


def inches(t: Column) -> Column:
    """'1/2', '1 1/2', '1-1/2', '2.5' -> number."""
    whole = F.regexp_extract(t, r"^\s*(?:(\d+(?:\.\d+)?)(?:[\s-]+(\d+)/(\d+))?|(\d+)/(\d+))", 1).try_cast("double")
    n = F.coalesce(*[F.regexp_extract(t, r"^\s*(?:\d+(?:\.\d+)?[\s-]+)?(\d+)/(\d+)", 1).try_cast("double")])
    d = F.regexp_extract(t, r"^\s*(?:\d+(?:\.\d+)?[\s-]+)?(\d+)/(\d+)", 2).try_cast("double")
    pure = t.rlike(r"^\s*\d+/\d+")
    return F.when(n.isNotNull() & (d != 0), F.when(pure, F.lit(0.0)).otherwise(F.coalesce(whole, F.lit(0.0))) + n / d).otherwise(whole)


def size_to_diameter(c: Column) -> Column:
    """Millimetres: fractions and values under 36 are inches (even with A), others millimetres."""
    t = F.upper(F.trim(c))
    v = inches(t)
    return F.when(t.rlike(r"\d/\d") | t.endswith("B") | (v < 36), v * 25.4).otherwise(v)


def pipe_size_mm(c: Column) -> Column:
    """A is millimetres, B inches; a bare number is millimetres."""
    t = F.upper(F.trim(c))
    return F.when(t.endswith("B"), inches(t) * 25.4).otherwise(F.regexp_extract(t, r"(\d+(?:\.\d+)?)", 1).try_cast("double"))


def ladder_index(c: Column) -> Column:
    """Index of the nearest nominal size, the lower on ties; NULL for no number."""
    v = first_number(c)
    steps = F.array(*[F.lit(float(s)) for s in LADDER])
    near = F.array_min(F.transform(steps, lambda s, i: F.struct(F.abs(s - v).alias("d"), i.alias("i"))))
    return F.when(v.isNotNull(), near["i"])


def size_score(a: Column, b: Column, mode: str = "PreferExact") -> tuple[Column, Column]:
    """(compatible, score) of two sizes: equal 1; a ladder step away .8, two .5, else 0; unreadable (true, 0)."""
    if mode == "Ignore":
        return F.lit(True), F.lit(1.0)
    na, nb = normalize_size(a), normalize_size(b)
    if mode == "ExactOnly":
        return na == nb, F.when(na == nb, 1.0).otherwise(0.0)
    step = F.abs(ladder_index(a) - ladder_index(b))
    return F.lit(True), F.when(na == nb, 1.0).when(step.isNull(), 0.0).when(step == 0, 1.0).when(step == 1, 0.8).when(step == 2, 0.5).otherwise(0.0)
