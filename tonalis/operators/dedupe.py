"""Duplicates on three axes: equal content, equal identity, and equal looks within a tolerance of duration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonalis.functions.text import compare_form, isrc_code
from tonalis.operators.library import number_rows

# Fixed value: seconds by which two durations may differ and still be equal.
TOLERANCE = 3.0


def same_duration(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    """Within the tolerance, both ends included; an unknown duration equals none."""
    return F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))


def repeated_hash(tracks: DataFrame) -> DataFrame:
    """(id, conserva): tracks whose content hash was seen before, with the first holder.

    The first holder is a minimum per hash (combined before the shuffle), joined back; no window over a hot hash.
    """
    h = tracks.select("id", F.nullif(F.lower(F.trim("hash_sha256")), F.lit("")).alias("_h")).filter("_h is not null")
    first = h.groupBy("_h").agg(F.min("id").alias("conserva"), F.count("*").alias("_n")).filter("_n > 1")
    return h.join(first, "_h").filter("id <> conserva").select("id", "conserva")


def observable_key() -> Column:
    """Title, artist and album in comparison form; null if any is blank."""
    parts = [compare_form(F.col(c)) for c in ("titulo", "artista_nombre", "album_titulo")]
    full = F.lit(True)
    for p in parts:
        full &= p != ""
    return F.when(full, F.concat_ws("\x1f", *parts))


def keep_rank() -> list[Column]:
    """What is kept of duplicates: favourites, then identified, then better and larger files, then played ones, then the first."""
    return [F.desc("favorita"), F.desc(F.coalesce("mb_recording_id", F.lit("")) != ""), F.desc(F.coalesce("isrc", F.lit("")) != ""), F.desc(F.coalesce("bitrate_kbps", F.lit(0))), F.desc("tamano_bytes"), F.desc("veces_reproducida"), F.asc("id")]


def _keep_struct() -> Column:
    """The same rank as one value whose maximum is the row to keep."""
    return F.struct(
        F.col("favorita").alias("a"), (F.coalesce("mb_recording_id", F.lit("")) != "").alias("b"), (F.coalesce("isrc", F.lit("")) != "").alias("c"),
        F.coalesce("bitrate_kbps", F.lit(0)).alias("d"), F.col("tamano_bytes").alias("e"), F.col("veces_reproducida").alias("f"), (-F.col("id")).alias("g"), F.col("duracion_seg").alias("t"),
    )


def observable_losers(tracks: DataFrame) -> DataFrame:
    """(id, conserva): tracks that look like the kept one of their key and last as long, within the tolerance of that one.

    One maximum per key (a struct in rank order) stands for the keeper, so a hot key sends a row a task.
    """
    rows = tracks.withColumn("_key", observable_key()).filter(F.col("_key").isNotNull()).withColumn("_rank", _keep_struct())
    best = rows.groupBy("_key").agg(F.max("_rank").alias("_best"), F.count("*").alias("_n")).filter("_n > 1")
    j = rows.select("id", "duracion_seg", "_key").join(best, "_key")
    return j.filter((F.col("id") != -F.col("_best.g")) & same_duration(F.col("duracion_seg"), F.col("_best.t"))).select("id", (-F.col("_best.g")).alias("conserva"))


def observable_groups(tracks: DataFrame) -> DataFrame:
    """(clave, n, primera, minimo, maximo): keys that several tracks share, with the range of their durations."""
    return tracks.withColumn("clave", observable_key()).filter(F.col("clave").isNotNull()).groupBy(F.md5("clave").alias("clave")).agg(F.count("*").alias("n"), F.min("id").alias("primera"), F.min("duracion_seg").alias("minimo"), F.max("duracion_seg").alias("maximo")).filter("n > 1")


def quality_score() -> Column:
    """Evidence of quality, capped at 1."""
    s = F.when(F.coalesce("mb_recording_id", F.lit("")) != "", 0.1).otherwise(0.0) + F.when(F.col("album_id").isNotNull(), 0.08).otherwise(0.0)
    s += F.when(F.coalesce("isrc", F.lit("")) != "", 0.06).otherwise(0.0) + F.when(F.col("track_number").isNotNull(), 0.04).otherwise(0.0)
    s += F.when(F.coalesce("bitrate_kbps", F.lit(0)) >= 256, 0.1).otherwise(0.0) + F.when((F.trim("titulo") != "") & (F.trim("artista_nombre") != ""), 0.05).otherwise(0.0)
    return F.bround(F.least(F.lit(1.0), s), 4)


def identity_repeats(tracks: DataFrame, gain: float = 0.08) -> DataFrame:
    """(id, conserva, tipo): tracks with the recording id or code of an earlier one; "mejorable" if clearly better than it."""
    t = tracks.select("id", "mb_recording_id", "isrc", quality_score().alias("_q"))
    keys = F.array_compact(F.array(F.when(F.coalesce(F.col("mb_recording_id"), F.lit("")) != "", F.concat(F.lit("mb:"), F.lower("mb_recording_id"))), F.when(isrc_code(F.col("isrc")).isNotNull(), F.concat(F.lit("isrc:"), isrc_code(F.col("isrc"))))))
    e = t.select("id", "_q", F.explode(keys).alias("_k"))
    first = e.groupBy("_k").agg(F.min(F.struct("id", "_q")).alias("_f"))
    hit = e.join(first, "_k").filter(F.col("id") != F.col("_f.id"))
    one = hit.groupBy("id").agg(F.min("_f").alias("_f"), F.first("_q").alias("_q"))
    return one.select("id", F.col("_f.id").alias("conserva"), F.when(F.col("_q") >= F.col("_f._q") + gain, "mejorable").otherwise("semantico").alias("tipo"))


def ranked(tracks: DataFrame, key: Column) -> DataFrame:
    """Tracks with their place in the keeping order of their key; a hot key is cut over several tasks."""
    return number_rows(tracks.withColumn("_key", key), ["_key"], keep_rank(), "puesto").drop("_key").withColumn("puesto", F.col("puesto").cast("int"))
