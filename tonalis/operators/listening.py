"""Listening statistics: plays per track and what is ranked, dated or missing by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonalis.operators.library import in_library


def plays_per_track(history: DataFrame) -> DataFrame:
    """(pista_id, n, ultima): plays and last play of each track; plays of tracks that are gone are left out.

    Exact repeats of a row count once: they are dropped in a partial aggregate by id and track before the shuffle.
    """
    once = history.filter(F.col("pista_id").isNotNull()).select("id", "pista_id", "reproducido_en").distinct()
    return once.groupBy("pista_id").agg(F.count("*").alias("n"), F.max("reproducido_en").alias("ultima"))


def distinct_plays(history: DataFrame) -> DataFrame:
    """The play log without exact repeats."""
    return history.dropDuplicates(["id", "pista_id", "reproducido_en"])


def with_plays(tracks: DataFrame, history: DataFrame) -> DataFrame:
    """Tracks with ``plays`` (from the log, else the counter) and ``ultima`` (last play)."""
    p = plays_per_track(history)
    return tracks.join(p, tracks["id"] == p["pista_id"], "left").withColumn("plays", F.coalesce("n", "veces_reproducida", F.lit(0))).drop("pista_id", "n")


def as_of(history: DataFrame) -> Column:
    """The time of the last play, as a scalar: stands for "now"."""
    return history.agg(F.max("reproducido_en")).scalar()


def playlists(sessions: DataFrame) -> DataFrame:
    """Sessions in the part of playlists."""
    return sessions.select(F.col("id").alias("lista_id"), F.col("prompt_original").alias("nombre"), "estado", F.lower("motor_version").alias("subtipo"), "objetivo_minutos", "creado_en", "finalizado_en")


def membership(scores: DataFrame) -> DataFrame:
    """(lista_id, pista_id, agregado): each track of each playlist once, with the first time it was scored."""
    return scores.groupBy(F.col("sesion_id").alias("lista_id"), "pista_id").agg(F.min("calculado_en").alias("agregado"))


def hash_order(*columns: str) -> Column:
    """A repeatable stand-in for a random order."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]))


def top_by_group(df: DataFrame, group: str, order: list[Column], n: int, rank: str = "_rn") -> DataFrame:
    """The n first rows of each group; the group limit prunes before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col(rank) <= n)


def album_plays(tracks: DataFrame, history: DataFrame) -> DataFrame:
    """(album_id, plays): plays of all tracks of an album, in the library or not."""
    p = plays_per_track(history)
    return tracks.select("id", "album_id").filter("album_id is not null").join(p, F.col("id") == F.col("pista_id")).groupBy("album_id").agg(F.sum("n").alias("plays"), F.max("ultima").alias("ultima"))


def never_played(tracks: DataFrame, history: DataFrame) -> DataFrame:
    """Tracks of the library without a play in the log or in the counter."""
    return in_library(tracks).filter(F.coalesce("veces_reproducida", F.lit(0)) == 0).join(history.select("pista_id").filter("pista_id is not null"), F.col("id") == F.col("pista_id"), "left_anti")


def home_mix(parts: list[tuple[str, DataFrame]], n: int, seed: str = "7") -> DataFrame:
    """Several sources mixed into one list: each item once (from its first source), one of the first source then two others.

    ``parts``: (name, DataFrame of tipo, id, nombre). The order inside the two pools is a seeded hash.
    """
    all_rows = None
    for k, (name, df) in enumerate(parts):
        rows = df.select("tipo", "id", "nombre", F.lit(k).alias("_source"), F.lit(name).alias("fuente"))
        all_rows = rows if all_rows is None else all_rows.unionByName(rows)
    once = all_rows.groupBy("tipo", "id").agg(F.min_by(F.struct("nombre", "_source", "fuente"), "_source").alias("s")).select("tipo", "id", "s.*")
    pool = (F.col("_source") > 0).cast("int")
    # the n first of each pool suffice: a group limit, then a window over at most 2n rows
    i = F.row_number().over(Window.partitionBy("_pool").orderBy(F.md5(F.concat_ws("|", F.lit(seed), "tipo", F.col("id").cast("string"))), "tipo", "id")) - 1
    placed = once.withColumn("_pool", pool).withColumn("_i", i).filter(F.col("_i") < n)
    slot = F.when(F.col("_pool") == 0, F.col("_i") * 3).otherwise(3 * F.floor(F.col("_i") / 2) + 1 + F.col("_i") % 2)
    return placed.select("tipo", "id", "nombre", "fuente", slot.cast("int").alias("lugar")).orderBy("lugar").limit(n)
