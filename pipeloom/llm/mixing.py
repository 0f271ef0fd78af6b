"""Mixing sources to target shares by systematic sampling.

Every document of a source is expected ``share * total / size of the source`` times.  The expected
copies are prefix-summed within the source over its documents in the order of their size, one random
offset per source is added, and a document is drawn once per whole number that its interval crosses.
As all documents of a source have the same expected copies, the prefix sum is the document's exact
position times them; it is taken in decimals, so that a rate however small is not rounded away.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pipeloom.llm.prefix import prefix_sums

#: Expected copies below one are kept to 23 decimals; a position may then have 13 digits.
FRACTION, POSITION = "decimal(23,23)", "decimal(13,0)"
#: Tables of at most as many sources are broadcast, larger ones are joined by their keys.
BROADCAST_SOURCES = 100_000


def draw(documents: DataFrame, targets: DataFrame, *, total_tokens: int | None = None, seed: int = 11) -> DataFrame:
    """Rows (source, doc_id, tokens, repeats) of the drawn documents.

    ``documents`` is (doc_id, source, tokens), ``targets`` (source, target_share, max_repeats).
    ``total_tokens`` None: the largest total at which every source can give its share within its
    repeats.  With a larger total given, a source that cannot gives all it may.

    * Sources are compared without outer blanks; a document without a source, or with one that has
      no target, is never drawn.  So is one without tokens.
    * A target whose source has no documents is left out and the other shares are scaled up alike.
      NULL, NaN or non-positive shares and repeats count as no target; of a source named twice the
      greatest row counts.
    * Ties in size are settled by doc_id; a repeated row is a document of its own; empty tables give no rows.
    """
    wanted = targets.select(F.trim("source").alias("source"), F.col("target_share").cast("double").alias("s"), F.col("max_repeats").cast("int").alias("m"))
    wanted = wanted.where("source is not null and s > 0 and not isnan(s) and m > 0").groupBy("source").agg(F.max(F.struct("s", "m")).alias("x")).select("source", "x.*")
    docs = documents.select("doc_id", F.trim("source").alias("source"), F.col("tokens").cast("bigint").alias("tokens")).where("tokens > 0")
    held = docs.groupBy("source").agg(F.sum("tokens").alias("held"))
    sources = wanted.join(held, "source")
    every = sources.agg(F.sum("s").alias("scale"), F.min(F.col("m") * F.col("held") / F.col("s")).alias("most"), F.count("*").alias("n")).first()
    none = documents.sparkSession.createDataFrame([], "source string, doc_id bigint, tokens bigint, repeats int")
    if not every["n"]:
        return none
    total = float(total_tokens) if total_tokens else every["most"] * every["scale"]
    rate = F.least(F.col("m").cast("double"), F.col("s") / F.lit(every["scale"]) * F.lit(total) / F.col("held"))
    rates = sources.withColumn("_e", rate).select(
        "source", F.floor("_e").cast("bigint").alias("_whole"), (F.col("_e") - F.floor("_e")).cast(FRACTION).alias("_part"),
        # the one random offset of the source, in fifteen decimals
        (F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(10**15)).cast("decimal(15,0)") / F.lit(10**15).cast("decimal(16,0)")).cast(FRACTION).alias("_o"),
    )
    if every["n"] <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    named = docs.join(F.broadcast(wanted.select("source")) if every["n"] <= BROADCAST_SOURCES else wanted.select("source"), "source", "left_semi")
    at = prefix_sums(named.withColumn("_one", F.lit(1).cast("bigint")), ["source"], ["tokens", "doc_id"], "_one", "_at")

    def crossed(position):
        return F.floor(position.cast(POSITION) * F.col("_part") + F.col("_o")).cast("bigint")

    repeats = (F.col("_whole") + crossed(F.col("_at") + 1) - crossed(F.col("_at"))).cast("int")
    return at.join(rates, "source").withColumn("repeats", repeats).select("source", "doc_id", "tokens", "repeats").where("repeats > 0")


def shares(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: its target and actual share, documents, copies and tokens."""
    got = drawn.groupBy("source").agg(
        F.count("*").alias("documents"), F.sum("repeats").alias("copies"), F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats")
    )
    want = targets.select(F.trim("source").alias("source"), "target_share", "max_repeats")
    joined = want.join(got, "source", "left").withColumn("_total", F.sum("tokens").over(W.partitionBy()))  # a row per target
    return joined.select(
        "source", "target_share", (F.coalesce("tokens", F.lit(0)) / F.col("_total")).alias("actual_share"), "max_repeats",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "copies", "tokens", "most_repeats")],
    )
