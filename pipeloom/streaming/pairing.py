"""Experiment observations as a stream: the two arms of a request paired as they arrive, and windowed rates.

The same functions take a batch, for which a watermark has no effect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ARMS = ("BASELINE", "CONTEXT")


def pair_arms(log: DataFrame, *, late: str = "1 day", apart: str = "2 days") -> DataFrame:
    """(request_key, run_id, base_id, context_id, length_delta) for arms of one request and run not further than ``apart``.

    Rows later than the watermark are dropped by the engine; a request or run that is NULL pairs with
    nothing; each observation of one arm pairs with each of the other.
    """
    cols = ("request_key", "run_id", "event_id", "created_at", "length_mm")
    base, context = (log.where(F.col("arm") == arm).select(*[F.col(c).alias(f"{arm[0].lower()}_{c}") for c in cols]).withWatermark(f"{arm[0].lower()}_created_at", late) for arm in ARMS)
    near = (F.col("c_created_at") >= F.col("b_created_at") - F.expr(f"INTERVAL {apart}")) & (F.col("c_created_at") <= F.col("b_created_at") + F.expr(f"INTERVAL {apart}"))
    same = (F.col("b_request_key") == F.col("c_request_key")) & (F.col("b_run_id") == F.col("c_run_id"))
    return base.join(context, same & near).select(
        F.col("b_request_key").alias("request_key"), F.col("b_run_id").alias("run_id"), F.col("b_event_id").alias("base_id"), F.col("c_event_id").alias("context_id"),
        (F.col("c_length_mm") - F.col("b_length_mm")).alias("length_delta"),
    )


def windowed_rates(log: DataFrame, *, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """(window_start, arm, n, success_rate) per tumbling window of event time."""
    w = log.withWatermark("created_at", late).groupBy(F.window("created_at", width), "arm")
    return w.agg(F.count("*").alias("n"), F.round(F.avg(F.col("success").cast("int")), 6).alias("success_rate")).select(F.col("window.start").alias("window_start"), "arm", "n", "success_rate")
