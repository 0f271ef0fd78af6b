"""Problem 5: dangling route references of three tables, per month."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipeloom.functions.text import norm_guid
from pipeloom.operators.references import orphan_references, orphan_report
from pipeloom.sources.tables import table

REFERRERS = ("tb_route_utility_group_member", "tb_route_stub_pattern", "tb_route_source_scope_route_member")


def route_references(spark: SparkSession, root: str) -> DataFrame:
    """Every reference with its judgement."""
    refs = None
    for name in REFERRERS:
        t = table(spark, root, name)
        one = t.select(
            F.lit(name).alias("table_name"), F.date_format("created_at", "yyyy-MM").alias("ref_month"),
            norm_guid(F.col("route_path_guid")).alias("guid"), F.col("created_at").cast("timestamp").alias("at"),
        )
        refs = one if refs is None else refs.unionByName(one)
    routes = table(spark, root, "tb_route_path")
    return orphan_references(
        refs, routes, ref_key=F.col("guid"), ref_time=F.col("at"),
        parent_key=norm_guid(F.col("route_path_guid")),
        valid_from=F.col("loaded_at").cast("timestamp"), valid_to=F.col("deleted_at").cast("timestamp"),
    )


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    orphans = route_references(spark, root).where("orphan_kind is not null")
    return orphans.select("table_name", "ref_month", F.col("ref_guid").alias("route_path_guid"), "orphan_kind").distinct()


def p5_report(spark: SparkSession, root: str) -> DataFrame:
    return orphan_report(route_references(spark, root))


_REFS = """
WITH g AS (
  SELECT 'tb_route_utility_group_member' AS table_name, route_path_guid, created_at FROM tb_route_utility_group_member
  UNION ALL SELECT 'tb_route_stub_pattern', route_path_guid, created_at FROM tb_route_stub_pattern
  UNION ALL SELECT 'tb_route_source_scope_route_member', route_path_guid, created_at FROM tb_route_source_scope_route_member),
n AS (SELECT table_name, created_at, strftime(created_at, '%Y-%m') AS ref_month,
  regexp_replace(lower(route_path_guid), '[\\s{}-]', '', 'g') AS h FROM g),
r AS (SELECT table_name, created_at, ref_month, regexp_replace(h, '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS guid
  FROM n WHERE h <> ''),
p AS (SELECT regexp_replace(regexp_replace(lower(route_path_guid), '[\\s{}-]', '', 'g'),
  '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS guid, loaded_at, deleted_at FROM tb_route_path),
j AS (SELECT r.table_name, r.ref_month, r.guid, r.created_at, count(p.guid) AS n_parents,
  bool_or(p.loaded_at <= r.created_at AND (p.deleted_at IS NULL OR p.deleted_at > r.created_at)) AS fine,
  bool_and(p.loaded_at > r.created_at) AS all_late, any_value(r.n) AS n
  FROM (SELECT table_name, ref_month, guid, created_at, count(*) AS n FROM r GROUP BY ALL) r LEFT JOIN p ON r.guid = p.guid
  GROUP BY r.table_name, r.ref_month, r.guid, r.created_at),
k AS (SELECT *, CASE WHEN n_parents = 0 THEN 'missing' WHEN fine THEN 'ok' WHEN all_late THEN 'late' ELSE 'deleted' END AS orphan_kind FROM j)
"""
SQL = {
    "p5_found": _REFS + "SELECT DISTINCT table_name, ref_month, guid AS route_path_guid, orphan_kind FROM k WHERE orphan_kind <> 'ok'",
    "p5_report": _REFS + "SELECT table_name, ref_month, orphan_kind, CAST(sum(n) AS BIGINT) AS n_refs, count(DISTINCT guid) AS n_guids FROM k GROUP BY 1, 2, 3",
}
QUERIES = {"p5_found": p5_found, "p5_report": p5_report}
