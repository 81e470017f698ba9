"""Job queues and runs: the next job, the last state, counts, and estimates of the time left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonalis.operators.library import number_rows


def next_job(jobs: DataFrame, state: str, pending: list[str], order: list[str]) -> DataFrame:
    """The first waiting job by the order (priority, then arrival): one pass, a row a task."""
    return jobs.filter(F.col(state).isin(pending)).orderBy(*[F.asc(c) for c in order]).limit(1)


def last_per_key(jobs: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The newest job of each key."""
    return jobs.groupBy(*keys).agg(F.max(F.struct(*order, *[v for v in values if v not in order])).alias("_j")).select(*keys, *[f"_j.{c}" for c in dict.fromkeys([*order, *values])])


def counts_by_state(jobs: DataFrame, state: str, known: list[str]) -> DataFrame:
    return jobs.agg(*[F.count_if(F.col(state) == k).alias(k) for k in known], F.count("*").alias("total"))


def recovered(jobs: DataFrame, state: str, running: str, waiting: str) -> DataFrame:
    """Interrupted jobs wait again."""
    return jobs.withColumn(state, F.when(F.col(state) == running, waiting).otherwise(F.col(state)))


def to_enqueue(items: DataFrame, last: DataFrame, key: str, state: str, active: list[str]) -> DataFrame:
    """Items without an active job."""
    busy = last.filter(F.col(state).isin(active)).select(key).distinct()
    return items.join(busy, key, "left_anti")


def eta_columns(total: Column, done: Column, elapsed_ms: Column) -> dict[str, Column]:
    """Mean time, rate and seconds left of a run; unknown before the first item is done."""
    left = F.greatest(total - done, F.lit(0))
    ok = (done > 0) & (elapsed_ms > 0)
    mean = F.when(ok, elapsed_ms / done)
    return {"ms_por_pista": mean, "por_minuto": F.when(ok, done / (elapsed_ms / 60000.0)).otherwise(0.0), "faltan_seg": F.when(ok, mean * left / 1000.0).when(left == 0, 0.0)}


def ewma(values: Column, alpha: float = 0.35) -> Column:
    """The exponentially weighted mean of an array of positive numbers in order; null without one."""
    some = F.filter(values, lambda x: x > 0)
    return F.when(F.size(some) > 0, F.aggregate(some, F.lit(None).cast("double"), lambda s, x: F.when(s.isNull(), x).otherwise(alpha * x + (1 - alpha) * s)))


def ewma_rows(df: DataFrame, group: str, order: list[Column], value: str, alpha: float = 0.35) -> DataFrame:
    """(group, media): the same per group of rows of any size: each value is weighted by its place from the end and summed."""
    rows = number_rows(df.filter(F.col(value) > 0), [group], order, "_k")  # ``order`` puts the newest first
    n = rows.groupBy(group).agg(F.max("_k").alias("_n"))
    w = F.when(F.col("_k") < F.col("_n"), alpha * F.pow(F.lit(1 - alpha), F.col("_k") - 1)).otherwise(F.pow(F.lit(1 - alpha), F.col("_n") - 1))
    return rows.join(n, group).groupBy(group).agg(F.sum(w * F.col(value)).alias("media"))


def mixed_mean(recent: Column, overall: Column) -> Column:
    """Three parts of the recent mean and one of the overall one."""
    return 0.75 * F.coalesce(recent, overall) + 0.25 * overall


def attempts(events: DataFrame, key: str, state: str, start: str) -> DataFrame:
    """(key, intentos, ultimo): starts of each job and its last state, folded from its events."""
    return events.groupBy(key).agg(F.count_if(F.col(state) == start).alias("intentos"), F.max_by(state, F.struct("ts", "event_id")).alias("ultimo"))


def smoothed_rest(steps: DataFrame, run: str, order: str, elapsed: str, total: str, share: float = 0.25) -> DataFrame:
    """(run, hechos, resto): the seconds that a run still needs, from the exponentially smoothed mean time of an item after each step.

    ``steps``: one row each time an item is done, ``elapsed`` seconds after the start. Unknown (null) before 3 seconds or 2 items, or when all is done. The
    fold is a weighted sum (the newest has ``share``, each older one what is left), so a run is aggregated and never collected.
    """
    numbered = number_rows(steps, [run], [F.asc(order), F.asc(elapsed)], "_k")
    usable = numbered.filter((F.col(elapsed) >= 3) & (F.col("_k") >= 2)).withColumn("_v", F.col(elapsed) / F.col("_k"))
    done = numbered.groupBy(run).agg(F.max("_k").alias("hechos"), F.max(total).alias("_t"))
    first = usable.groupBy(run).agg(F.min("_k").alias("_f"))  # time only grows, so the usable steps are the last ones
    ranked = usable.join(done.select(run, "hechos"), run).join(first, run)
    weight = F.pow(F.lit(1 - share), F.col("hechos") - F.col("_k")) * F.when(F.col("_k") == F.col("_f"), 1.0).otherwise(share)
    mean = ranked.groupBy(run).agg(F.sum(F.col("_v") * weight).alias("_m"))
    rest = F.when((F.col("_t") > F.col("hechos")) & F.col("_m").isNotNull(), F.greatest(F.lit(1), F.round(F.col("_m") * (F.col("_t") - F.col("hechos"))).cast("int")))
    return done.join(mean, run, "left").select(run, F.col("hechos").cast("int").alias("hechos"), rest.alias("resto"))


def queue_rest(done: Column, total: Column, elapsed: Column, share_of_job: Column, job_elapsed: Column) -> Column:
    """The seconds that a queue still needs: from the mean of finished jobs, else from the progress of the running one (over 5 %), else unknown."""
    left = F.greatest(F.lit(0), total - done)
    one = F.greatest(F.lit(0.001), job_elapsed) / share_of_job
    return F.when((done > 0) & (elapsed > 0), F.greatest(F.lit(0.001), elapsed) / done * left).when((share_of_job > 0.05) & (job_elapsed > 0) & (left > 0), one * (1 - share_of_job) + one * F.greatest(F.lit(0), left - 1))
