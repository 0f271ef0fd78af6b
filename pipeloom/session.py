"""Session defaults and lineage cutting."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "pipeloom", cores: str | int = "*", **extra: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the submitter's settings hold."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "12g",
        "spark.driver.host": "127.0.0.1",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **extra,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    spark = builder.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder and return it without its lineage.

    The folder is the one the cluster names in ``spark.checkpoint.dir``.  Where that is unset a temporary
    folder of this machine is used, but only by a local master: elsewhere it would not be shared.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="pipeloom-"))
    return df.checkpoint(eager=True)


def let_go(spark: SparkSession) -> None:
    """Have the shuffle files and checkpoints removed that nothing refers to any more; else they stay until the driver happens to collect its garbage."""
    spark.sparkContext._jvm.System.gc()


def shuffle_width(spark: SparkSession) -> int:
    """Number of partitions for an explicit repartitioning."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of ``df`` is called like that."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out
