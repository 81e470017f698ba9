"""JSON lines: reports, event logs and indexes in which a later line replaces an earlier one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Lines of the given schema; broken lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """One line a row; ``append`` adds files to a log."""
    df.write.mode("append" if append else "error").json(path)


def last_by_key(lines: DataFrame, key: str, order: Column | str, value: str) -> DataFrame:
    """(key, value): the last value of each key that is not empty."""
    some = lines.filter(F.col(key).isNotNull() & (F.trim(F.coalesce(F.col(value).cast("string"), F.lit(""))) != ""))
    return some.groupBy(key).agg(F.max_by(value, order).alias(value))


def first_present(*columns: str) -> Column:
    """The first of several columns that is neither null nor blank."""
    return F.coalesce(*[F.nullif(F.trim(F.col(c)), F.lit("")) for c in columns])
