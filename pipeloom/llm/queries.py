"""Registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipeloom.functions.text import norm_equipment_key
from pipeloom.llm import oracles
from pipeloom.llm.mixing import draw, shares
from pipeloom.llm.neighbours import k_nearest, mutual, unit_vectors
from pipeloom.llm.packing import pack, packing_report
from pipeloom.llm.residue import find_residue, without_residue
from pipeloom.llm.runs import collapse_runs
from pipeloom.llm.sequences import shared_directions
from pipeloom.llm.tokens import token_counts
from pipeloom.llm.topn import latest_version, top_n_per_group
from pipeloom.session import cut_lineage
from pipeloom.sources.tables import table


def p1_runs(spark: SparkSession, root: str) -> DataFrame:
    runs = collapse_runs(table(spark, root, "tb_route_stub_pattern"), "pattern_id", "dir_seq", "stub_points", version="created_at")
    return runs.withColumn("duration_mm", F.round("duration_mm", 4))


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    found = collapse_runs(table(spark, root, "tb_route_stub_pattern"), "pattern_id", "dir_seq", "stub_points", version="created_at", least=2)
    return found.select("pattern_id", "seq_field", "first_pos", "last_pos")


def p1_near_identical(spark: SparkSession, root: str) -> DataFrame:
    """Legs merged while their directions differ by less than about 18 degrees."""
    return collapse_runs(table(spark, root, "tb_route_stub_pattern"), "pattern_id", "dir_seq", "stub_points", version="created_at", near=0.95)


def _ranked_bends(spark: SparkSession, root: str, n: int) -> DataFrame:
    bends = table(spark, root, "tb_route_bend_feature_pattern").select(
        "pattern_id", "updated_at", "frequency_score", "utility", norm_equipment_key(F.col("equipment_key")).alias("equipment_key")
    )
    score = F.col("frequency_score")
    valid = latest_version(bends, "pattern_id", "updated_at").where(score.isNotNull() & ~F.isnan(score) & score.between(0.0, 1.0))
    return top_n_per_group(valid.drop("updated_at"), ["equipment_key", "utility"], "frequency_score", "pattern_id", n)


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return _ranked_bends(spark, root, 5).select("equipment_key", "utility", "pattern_id")


def p2_top20(spark: SparkSession, root: str) -> DataFrame:
    return _ranked_bends(spark, root, 20)


def p4_patterns(spark: SparkSession, root: str) -> DataFrame:
    return shared_directions(table(spark, root, "tb_route_stub_pattern"), table(spark, root, "tb_route_utility_group_member"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return p4_patterns(spark, root).select("seq_field", "step_pattern")


SIMILAR = {"feature_centroid": 0.985, "context_centroid": 0.985, "feat_json": 0.99999}


def _vectors(spark: SparkSession, root: str) -> DataFrame:
    """Vectors of the three fields, scaled to length 1."""
    groups = table(spark, root, "tb_route_utility_group_vector")
    both = groups.select("group_vector_id", F.explode(F.create_map(
        F.lit("feature_centroid"), F.col("feature_centroid"), F.lit("context_centroid"), F.col("context_centroid"))).alias("f", "v"))
    out = unit_vectors(both, F.col("f"), F.col("group_vector_id"), F.col("v"), F.lit(30))
    stubs = table(spark, root, "tb_route_stub_pattern")
    return out.unionByName(unit_vectors(stubs, F.lit("feat_json"), F.col("pattern_id"), F.from_json("feat_json", "array<double>"), F.lit(24)))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    pairs = mutual(k_nearest(_vectors(spark, root), 5, min_similarity={f: s - 1e-9 for f, s in SIMILAR.items()}, certainty=0.999999))
    least = F.create_map(*[F.lit(x) for kv in SIMILAR.items() for x in kv])
    return pairs.where(F.col("similarity") >= least[F.col("field")]).select(F.col("field").alias("vec_field"), "id_a", "id_b")


def p3_search(spark: SparkSession, root: str) -> DataFrame:
    """The five most similar vectors of every vector whose identifier, as a hexadecimal number, is divisible by 100."""
    number = F.conv(F.substring("id", -12, 12), 16, 10).cast("bigint")
    found = k_nearest(_vectors(spark, root), 5, queries=F.coalesce(number % 100 == 0, F.lit(False)), certainty=0.95)
    return found.select(F.col("field").alias("vec_field"), "id", "other", F.round("similarity", 9).alias("cosine"), "position")


def _sizes(spark: SparkSession, root: str) -> DataFrame:
    """Documents with their size; written once, as counting tokens is the dear part."""
    return cut_lineage(token_counts(table(spark, root, "documents"), "doc_id", "text", F.col("source")))


def p6_packed(spark: SparkSession, root: str) -> DataFrame:
    return pack(_sizes(spark, root), table(spark, root, "pack_container"))


def p6_report(spark: SparkSession, root: str) -> DataFrame:
    return packing_report(p6_packed(spark, root))


def p7_drawn(spark: SparkSession, root: str) -> DataFrame:
    return draw(_sizes(spark, root), table(spark, root, "mix_target"))


def p7_shares(spark: SparkSession, root: str) -> DataFrame:
    return shares(p7_drawn(spark, root), table(spark, root, "mix_target"))


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return find_residue(table(spark, root, "documents"), "doc_id", "text").select("doc_id").distinct()


def p8_kinds(spark: SparkSession, root: str) -> DataFrame:
    found = find_residue(table(spark, root, "documents"), "doc_id", "text")
    return found.select("doc_id", F.array_join("kinds", ",").alias("kinds"))


def p8_corpus(spark: SparkSession, root: str) -> DataFrame:
    """The documents that stay in the corpus."""
    docs = table(spark, root, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return without_residue(docs, "doc_id", "text").select("doc_id", "lang", "source", "n_chars")


QUERIES = {
    "p1_found": p1_found, "p1_runs": p1_runs, "p1_near_identical": p1_near_identical,
    "p2_found": p2_found, "p2_top20": p2_top20,
    "p3_found": p3_found, "p3_search": p3_search,
    "p4_found": p4_found, "p4_patterns": p4_patterns,
    "p6_packed": p6_packed, "p6_report": p6_report, "p7_drawn": p7_drawn, "p7_shares": p7_shares,
    "p8_found": p8_found, "p8_kinds": p8_kinds, "p8_corpus": p8_corpus,
}
SQL = {k: v for k, v in oracles.SQL.items() if k in QUERIES}
