"""Streams run to the end of what is there, compared with their batch results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonalis.materialise import shared_folder
from tonalis.plans.registry import Registry
from tonalis.streaming import events as E
from tonalis.tables import Tables

query = Registry()


def _stream(t: Tables) -> DataFrame:
    return E.read_stream(t.spark, f"{t.folder}/events.parquet*", t.events.schema)


def _folder(t: Tables) -> str:
    return f"{shared_folder(t.spark)}/tonalis-streams/{uuid.uuid4().hex}"


@query("""WITH w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS desde, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT desde, event_type, n FROM w WHERE desde + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def stream_windows(t: Tables) -> DataFrame:
    """Events per window of six hours; only windows that the watermark closed come out."""
    out = E.run_once(E.window_counts(_stream(t), "ts", "event_type", "6 hours"), _folder(t))
    return out.select(F.col("desde").cast("timestamp_ntz").alias("desde"), "event_type", "n")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_first_seen(t: Tables) -> DataFrame:
    """Events without repeats, counted."""
    out = E.run_once(E.first_seen(_stream(t), ["event_id"], "ts"), _folder(t))
    return out.groupBy("event_type").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 1 DAY AS nueva FROM events), s AS (SELECT user_id, ts, sum(coalesce(nueva, true)::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e),
w AS (SELECT user_id, min(ts) AS desde, max(ts) + INTERVAL 1 DAY AS hasta, count(*) AS n FROM s GROUP BY user_id, k) SELECT desde, hasta, user_id, n FROM w WHERE hasta <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def stream_sessions(t: Tables) -> DataFrame:
    """Runs of events of a user without a pause of a day, as far as the watermark closed them."""
    out = E.run_once(E.session_windows(_stream(t), "ts", "user_id", "1 day"), _folder(t))
    return out.select(F.col("desde").cast("timestamp_ntz").alias("desde"), F.col("hasta").cast("timestamp_ntz").alias("hasta"), "user_id", "n")
