"""The streaming operators over files that arrive, against the same functions over the batch."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pipeloom.operators.order import numbered
from pipeloom.streaming import pairing

LOG = "request_key string, run_id string, arm string, created_at timestamp, event_id bigint, success boolean, length_mm double, bends int, reason string"


def _log(spark, path):
    start = datetime(2024, 1, 1)
    rows = [(f"q{i % 7}", f"r{i % 3}", ("BASELINE", "CONTEXT")[i % 2], start + timedelta(hours=i), i, i % 5 > 0, float(i), i % 4, "x") for i in range(200)]
    rows += [(None, "r0", "CONTEXT", start, 900, True, 1.0, 0, "x")]
    df = spark.createDataFrame(rows, LOG)
    df.repartition(3).write.parquet(path)
    return df


def _run(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return q


@pytest.mark.parametrize("what", ["pairs", "rates"])
def test_stream_equals_batch(spark, tmp_path, what):
    batch = _log(spark, str(tmp_path / "log"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    f = (lambda d: pairing.pair_arms(d, late="60 days")) if what == "pairs" else (lambda d: pairing.windowed_rates(d, late="60 days"))
    _run(f(stream), f"out_{what}", "append" if what == "pairs" else "complete")
    got = sorted(map(tuple, spark.sql(f"select * from out_{what}").collect()), key=repr)
    assert got == sorted(map(tuple, f(batch).collect()), key=repr) and got


def test_numbers_follow_the_order(spark):
    df = spark.range(1000).select(F.xxhash64("id").alias("h"), "id", F.lit(0).alias("_part"), F.lit(1).alias("NUMBER"))
    got = numbered(df, F.col("h").desc(), F.col("id"), partitions=5).collect()
    want = sorted(got, key=lambda r: (-r.h, r.id))
    assert [r.number for r in want] == list(range(1, 1001))
    assert numbered(df.limit(0), F.col("h")).count() == 0
