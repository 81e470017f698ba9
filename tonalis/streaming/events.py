"""The event and play logs as streams: windows, sessions, late data, de-duplication, and state per key.

These are extras of the engine: the same results as the batch operators, kept up to date while files arrive.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files of a folder (or a glob) as a stream; times without zone become instants for the watermark."""
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def window_counts(events: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """(desde, hasta, kind, n): events per window; what is later than ``late`` behind the newest is dropped."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, late).groupBy(w.alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("desde"), F.col("w.end").alias("hasta"), kind, "n")


def session_windows(events: DataFrame, time: str, who: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(desde, hasta, who, n): runs of events with no pause of ``gap``."""
    s = F.session_window(time, gap)
    return events.withWatermark(time, late).groupBy(s.alias("w"), who).agg(F.count("*").alias("n")).select(F.col("w.start").alias("desde"), F.col("w.end").alias("hasta"), who, "n")


def first_seen(events: DataFrame, keys: list[str], time: str, late: str = "10 minutes") -> DataFrame:
    """Events without repeats that arrive within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def running_plays(plays: DataFrame, key: str) -> DataFrame:
    """(key, n): a counter per key that survives restarts in the state store."""

    def count(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = (state.get[0] if state.exists else 0) + sum(len(b) for b in batches)
        state.update((n,))
        yield pd.DataFrame({key: [k[0]], "n": [n]})

    return plays.groupBy(key).applyInPandasWithState(count, f"{key} long, n long", "n long", "update", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Process what is there now into a Parquet table under ``folder`` (with its checkpoint) and return the table."""
    q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")
