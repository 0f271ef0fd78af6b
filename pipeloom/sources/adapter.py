"""Domain relations over the raw tables: one row per route, stub, group and member, typed columns.

Loaders in the field meet differing column names and spellings; everything of that kind is settled
here, so the operators see fixed schemas.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pipeloom.functions.text import norm_equipment_key, norm_guid, norm_text
from pipeloom.sources.tables import table

POINT = "struct<x:double,y:double,z:double>"
_NUMBER = r"(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)"


def first_existing(df: DataFrame, *names: str) -> Column:
    """The first of the aliases that the table has, NULL if it has none."""
    have = {c.lower(): c for c in df.columns}
    return next((F.col(have[n.lower()]) for n in names if n.lower() in have), F.lit(None).cast("string"))


def point(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"))


def _raw_points(text: Column) -> Column:
    """Points of a JSON list, NULL where an entry is none: list, object with any-case keys, quoted numbers, or separated text."""
    numbers = lambda t: F.transform(F.regexp_extract_all(t, F.lit(_NUMBER), F.lit(1)), lambda n: n.cast("double"))
    key = lambda t, k: F.regexp_extract(t, rf'(?i)"{k}"\s*:\s*"?{_NUMBER}', 1).try_cast("double")
    keyed = lambda t: F.array(*[key(t, k) for k in "xyz"])
    # the numbers of an entry are taken out once, then looked at
    values = F.transform(F.from_json(text, "array<string>"), lambda t: F.when(F.ltrim(t).startswith("{"), keyed(t)).otherwise(numbers(t)))
    return F.transform(values, lambda v: F.when(F.size(v) == 3, point(v[0], v[1], v[2])))


def parse_points(text: Column) -> Column:
    """Points of a JSON list; NULL if it is no valid list or holds something that is no point."""
    points = _raw_points(text)
    return F.when(~F.exists(points, lambda p: p.isNull() | p["x"].isNull() | p["y"].isNull() | p["z"].isNull()), points)


def newest(df: DataFrame, *keys: str, version: str) -> DataFrame:
    """One row per key: the newest version, so delivered copies collapse and no row mixes two versions.

    Each column is aggregated beside the version, so a query that needs two columns reads three.  Rows of
    one version are taken for copies; should they differ, each column has its greatest value, NULL last.
    """
    rest = [c for c in df.columns if c not in (*keys, version)]
    return df.groupBy(*keys).agg(F.max(version).alias(version), *[F.max(F.struct(version, c))[c].alias(c) for c in rest])


def routes(spark: SparkSession, root: str) -> DataFrame:
    """One row per route: guid, keys, endpoints, length, bends as last loaded."""
    t = table(spark, root, "tb_route_path")
    rows = t.select(
        norm_guid(F.col("route_path_guid")).alias("guid"), "loaded_at", norm_text(F.col("process_name")).alias("process"), norm_equipment_key(F.col("equipment_tag")).alias("equipment_key"),
        norm_text(first_existing(t, "equipment_name", "equipment")).alias("equipment_name"), norm_text(F.col("utility_group")).alias("utility_group"),
        norm_text(F.col("source_utility")).alias("utility"), norm_text(F.col("source_size")).alias("size"), norm_text(F.col("target_owner_name")).alias("owner"),
        norm_text(F.col("bay")).alias("bay"), F.col("project_scope_key").alias("project"), F.col("model_revision_key").alias("revision"),
        "source_posx", "source_posy", "source_posz", "target_posx", "target_posy", "target_posz", "total_length", "bend_count", "deleted_at",
    )
    return newest(rows.where("guid is not null"), "guid", version="loaded_at")


def stubs(spark: SparkSession, root: str) -> DataFrame:
    """One row per stub pattern."""
    return newest(table(spark, root, "tb_route_stub_pattern"), "pattern_id", version="created_at")


def polylines(spark: SparkSession, root: str) -> DataFrame:
    """(guid, pts): stub points as a polyline of two or more points."""
    s = newest(table(spark, root, "tb_route_stub_pattern").select("pattern_id", "stub_points", "created_at"), "pattern_id", version="created_at")
    # the one-row generator keeps the parsing from being copied into the filter and every later expression
    lines = s.select(F.col("pattern_id").alias("guid"), F.explode(F.array(_raw_points(F.col("stub_points")))).alias("pts"))
    return lines.where((F.size("pts") >= 2) & ~F.exists("pts", lambda p: p.isNull() | p["x"].isNull() | p["y"].isNull() | p["z"].isNull()))


def groups(spark: SparkSession, root: str) -> DataFrame:
    """One row per pipe group, with its vectors."""
    return newest(table(spark, root, "tb_route_utility_group_vector"), "group_vector_id", version="updated_at")


def is_vector(v: Column, dim: int) -> Column:
    """A vector of ``dim`` finite numbers, not all zero."""
    return F.coalesce((F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & F.exists(v, lambda x: x != 0), F.lit(False))


def members(spark: SparkSession, root: str) -> DataFrame:
    """One row per (group, route, order)."""
    t = table(spark, root, "tb_route_utility_group_member").withColumn("guid", norm_guid(F.col("route_path_guid")))
    return newest(t.where("guid is not null").drop("route_path_guid"), "group_vector_id", "guid", "member_order", version="created_at")


def obstacles(spark: SparkSession, root: str) -> DataFrame:
    """Boxes: columns and beams, from the parts' keys and sizes."""
    p = table(spark, root, "part")
    k, s = F.col("p_partkey"), F.col("p_size").cast("double")
    x, y, z = (k * 7919 % 90000).cast("double"), (k * 104729 % 60000).cast("double"), (F.lit(8000) + k * 31 % 9000).cast("double")
    column = k % 2 == 0
    wx, wy, wz = s * 10 + 100, F.when(column, s * 10 + 100).otherwise(s * 60 + 500), F.when(column, F.lit(6000.0)).otherwise(F.lit(400.0))
    return p.select(
        k.alias("id"), F.when(column, "COLUMN").otherwise("BEAM").alias("kind"), x.alias("minx"), y.alias("miny"), z.alias("minz"),
        (x + wx).alias("maxx"), (y + wy).alias("maxy"), (z + wz).alias("maxz"),
    )


def ab_log(spark: SparkSession, root: str) -> DataFrame:
    """Paired-experiment observations, from the events: request, run, arm, success, metrics."""
    e = table(spark, root, "events")
    return e.select(
        F.concat_ws("|", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM")).alias("request_key"), F.date_format("ts", "yyyy-MM-dd").alias("run_id"),
        F.when(F.col("event_id") % 2 == 0, "CONTEXT").otherwise("BASELINE").alias("arm"), F.col("ts").alias("created_at"), "event_id",
        (F.col("event_type") != "error").alias("success"), F.col("value").alias("length_mm"), (F.col("event_id") % 7).cast("int").alias("bends"),
        F.col("event_type").alias("reason"),
    )
