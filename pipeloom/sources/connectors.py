"""Reading and copying other sources: files of the usual formats and tables over JDBC, with declared types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Declared column types of small databases, by the first keyword they contain.
TYPE_WORDS = (("BIGINT", "bigint"), ("BOOL", "boolean"), ("INT", "bigint"), ("CHAR", "string"), ("CLOB", "string"), ("TEXT", "string"), ("BLOB", "binary"), ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double"), ("TIMESTAMP", "timestamp"), ("DATE", "timestamp"), ("DEC", "decimal(38,9)"), ("NUM", "decimal(38,9)"))


def spark_type(declared: str | None) -> str:
    """Type for a declared column type; text where it says nothing known."""
    up = (declared or "").upper()
    return next((t for w, t in TYPE_WORDS if w in up), "string")


def read(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    """Files of ``fmt`` (parquet, orc, csv, json, text, binaryFile); a schema spares the pass that infers one."""
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def read_jdbc(spark: SparkSession, url: str, table: str, *, key: str | None = None, low: int = 0, high: int = 0, parts: int = 8, **options: str) -> DataFrame:
    """A table over JDBC; with a numeric ``key`` it is read in ``parts`` ranges at once."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("fetchsize", "10000").options(**options)
    if key:
        reader = reader.option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.load()


def typed(df: DataFrame, declared: dict[str, str]) -> DataFrame:
    """Columns cast to their declared types; what cannot be read becomes NULL."""
    def one(c: str) -> Column:
        want = spark_type(declared.get(c)) if c in declared else None
        return F.col(c) if want is None else (F.col(c).cast("binary") if want == "binary" else F.col(c).try_cast(want)).alias(c)

    return df.select(*[one(c) for c in df.columns])
