"""Audits of the library: duplicates by key, missing or stale analysis, orphans, coverage and pools to draw from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonalis.operators.library import in_library
from tonalis.operators.listening import hash_order, plays_per_track


def duplicate_keys(tracks: DataFrame) -> DataFrame:
    """(clave, n): recording id, else ISRC, else title and artist, wherever several tracks share it."""
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    key = F.coalesce(blank("mb_recording_id"), blank("isrc"), F.concat_ws("::", F.lower("titulo"), F.lower("artista_nombre")))
    return tracks.groupBy(key.alias("clave")).agg(F.count("*").alias("n"), F.min("id").alias("primera")).filter("n > 1")


def missing(left: DataFrame, right: DataFrame, key: str, other: str) -> DataFrame:
    """Rows of ``left`` without a partner."""
    return left.join(right.select(F.col(other).alias("_k")).filter("_k is not null"), F.col(key) == F.col("_k"), "left_anti")


def stale(tracks: DataFrame, analysed: DataFrame) -> DataFrame:
    """Tracks whose analysis is missing or older than their last change."""
    a = analysed.select(F.col("id").alias("_id"), "analizado_en")
    j = tracks.select("id", "actualizado_en").join(a, F.col("id") == F.col("_id"), "left")
    cause = F.when(F.col("_id").isNull(), "falta").when(F.col("analizado_en") < F.col("actualizado_en"), "viejo")
    return j.select("id", cause.alias("causa")).filter("causa is not null")


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """Present values of each column, one row a column, in one pass."""
    n = df.agg(F.count("*").alias("_all"), *[F.count_if(F.col(c).isNotNull() & ~F.isnan(F.col(c))).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("campo"), F.col(c).alias("presentes"), F.round(F.col(c) / F.nullif(F.col("_all"), F.lit(0)), 6).alias("parte")) for c in columns])
    return n.select(F.explode(pairs).alias("p")).select("p.*")


def state_counts(df: DataFrame, column: str, known: list[str], default: str) -> DataFrame:
    """Counts for a fixed list of states: unknown and null ones are counted as ``default``, absent ones as 0."""
    state = F.coalesce(F.col(column), F.lit(default))
    state = F.when(state.isin(*known), state).otherwise(default)
    return df.agg(*[F.count_if(state == k).alias(k) for k in known])


def pool(tracks: DataFrame, rule: Column, n: int = 50) -> DataFrame:
    """A repeatable draw of library tracks that meet a rule."""
    return in_library(tracks).filter(rule).select("id", "titulo").orderBy(hash_order("id"), "id").limit(n)


def rediscovery_pool(tracks: DataFrame, history: DataFrame, n: int = 50) -> DataFrame:
    """Played tracks, those without activity for the longest time first."""
    p = plays_per_track(history)
    j = in_library(tracks).join(p, F.col("id") == F.col("pista_id"))
    return j.select("id", "titulo", F.greatest("ultima", "ultimo_acceso").alias("reciente")).orderBy(F.asc_nulls_first("reciente"), "id").limit(n)


def sample_round(candidates: DataFrame, seen: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """n candidates by seeded hash, without the seen ones unless that would leave none."""
    flagged = candidates.join(seen.select(F.col(key).alias("_s")).distinct(), F.col(key) == F.col("_s"), "left").withColumn("_fresh", F.col("_s").isNull())
    any_fresh = flagged.agg(F.coalesce(F.bool_or("_fresh"), F.lit(False))).scalar()
    return flagged.filter(F.col("_fresh") | ~any_fresh).orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"))), key).limit(n).drop("_s", "_fresh")


def fragment_start(duration: Column) -> Column:
    """Where a preview starts: at the beginning of short tracks, else at 30 %."""
    return F.when(duration <= 60, 0.0).otherwise(duration * 0.30)


def never_pool(tracks: DataFrame, history: DataFrame, most: int = 50) -> DataFrame:
    """Library tracks without a play and with a counter of 0; if there is none, those played at most twice."""
    heard = history.filter("pista_id is not null").select(F.col("pista_id").alias("id")).distinct()
    fresh = tracks.filter(F.coalesce("veces_reproducida", F.lit(0)) == 0).join(heard, "id", "left_anti")
    none = in_library(fresh).agg(F.count("*") == 0).scalar()
    relaxed = tracks.filter((F.coalesce("veces_reproducida", F.lit(0)) <= 2) & none)
    return pool(fresh.select("id", "titulo", "estado").unionByName(relaxed.select("id", "titulo", "estado")), F.lit(True), most)


def lacking(rows: DataFrame, key: str, needed: dict[str, str]) -> DataFrame:
    """(key, faltan): the names of the columns (name -> column) that are null in each row; complete rows are left out."""
    names = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(n)) for n, c in needed.items()]))
    return rows.select(key, names.alias("faltan")).filter(F.size("faltan") > 0)
