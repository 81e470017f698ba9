"""The N best items of every group, whatever the size of the group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_limit(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, rank: str = "_rn") -> DataFrame:
    """Rows of rank 1..n of every group, with the rank in column ``rank``.

    ``row_number() <= n`` is what the optimiser's group limit recognises: each map task keeps its own n best rows of a
    group before the shuffle, so a group with a third of all rows sends at most n rows a task.
    """
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col(rank) <= n)


def top_items(items: DataFrame, parents: DataFrame, *, item: str, tie: str, score: str, parent_id: str, group: str, n: int = 5, rejected: str | None = None) -> DataFrame:
    """For each group of ``parents`` the ``n`` rows of ``items`` with the highest score.

    ``items`` has a row per (``item``, ``tie``), joined by ``item`` = ``parents.parent_id``; ``group`` comes from ``parents``.
    Result: group, tie, item, score, puesto (1 is best). Order: score descending, item ascending, tie ascending.

    Defined cases: exact repeats of a row count once; null and NaN scores, null ids, and rows whose ``rejected`` is true don't
    compete (a null mark is no rejection); items without a parent and parents without a group give nothing; a group with
    fewer than ``n`` rows gives all of them; empty tables give an empty result; further columns are ignored.

    Plan: repeats vanish in a partial aggregate before the first shuffle; then each item keeps its own ``n`` best (the best of
    a group are among the best of its items), so neither a hot item nor a hot group reaches a task whole; the second
    shuffle (by item) serves the window and the join; the third carries at most n rows a group and task.
    """
    ok = F.col(score).isNotNull() & ~F.isnan(score)
    if rejected:
        ok &= ~F.coalesce(F.col(rejected), F.lit(False))
    scored = (
        items.filter(ok & F.col(item).isNotNull() & F.col(tie).isNotNull())
        .select(F.col(item).alias("_item"), F.col(tie).alias("_tie"), F.col(score).alias("_score"))
        .distinct()
    )
    best = rank_limit(scored, ["_item"], [F.desc("_score"), F.asc("_tie")], n).drop("_rn")
    # parents has one row an id; the aggregate also holds against repeated parent rows
    owner = parents.filter(F.col(group).isNotNull() & F.col(parent_id).isNotNull()).select(F.col(parent_id).alias("_item"), F.col(group).alias("_group")).distinct()
    ranked = rank_limit(best.join(owner, "_item"), ["_group"], [F.desc("_score"), F.asc("_item"), F.asc("_tie")], n)
    return ranked.select(F.col("_group").alias(group), F.col("_tie").alias(tie), F.col("_item").alias(item), F.col("_score").alias(score), F.col("_rn").alias("puesto"))
