"""Computations behind an interface: suggestions, lyrics, colours and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonalis.functions.text import collapse
from tonalis.materialise import materialise


def keep_unless_empty(df: DataFrame, rule: Column) -> DataFrame:
    """The rows that meet a rule, or all of them if none does."""
    any_hit = df.agg(F.coalesce(F.bool_or(rule), F.lit(False))).scalar()
    return df.withColumn("_any", any_hit).filter(rule | ~F.col("_any")).drop("_any")


def first_filters(df: DataFrame, rules: list[str]) -> DataFrame:
    """:func:`keep_unless_empty` for boolean columns one after the other, in a single pass over ``df``.

    Which combinations of the columns occur is counted once (at most two to the power of their number); the chain is decided on
    that, and the rows are filtered by the result.
    """
    seen = [tuple(r) for r in df.select(*rules).distinct().collect()]
    for k in range(len(rules)):
        seen = [r for r in seen if r[k]] or seen
    keep = F.lit(False)
    for r in seen:
        same = F.lit(True)
        for name, value in zip(rules, r):
            same &= F.col(name) == F.lit(value)
        keep |= same
    return df.filter(keep)


def suggestion_score() -> Column:
    """How welcome a track is next: counts, favourites, quality and length add, having been heard subtracts."""
    zero = F.lit(0.0)
    length = F.coalesce("duracion_seg", zero)
    return (
        F.least(F.lit(3.0), F.coalesce("veces_reproducida", F.lit(0)) * 0.12)
        + F.when(F.col("favorita") == 1, 1.2).otherwise(zero)
        + F.least(F.lit(1.0), F.greatest(zero, F.coalesce("bitrate_kbps", F.lit(0)) - 160.0) / 128.0)
        + F.when(length.between(45, 540), 0.4).when((length > 0) & (length < 30), -1.0).when(length > 900, -2.0).otherwise(zero)
        + F.when(F.col("ultimo_acceso").isNotNull(), -2.5).otherwise(zero)
    )


def suggest(tracks: DataFrame, recent: DataFrame, current: int, n: int = 40, seed: str = "7") -> DataFrame:
    """(id, puntaje, puesto): the candidates for the next track, and a repeatable draw among them weighted by rank (puesto 1 is drawn).

    Recent tracks, then the current artist and album, are left out as long as something remains.
    """
    now = tracks.filter(F.col("id") == current).select("artista_id", "album_id").head(1)
    artist, album = (now[0].artista_id, now[0].album_id) if now else (None, None)
    heard = recent.select(F.col("pista_id").alias("_r")).filter("_r is not null").distinct()
    scored = tracks.filter(F.col("id") != current).join(heard, F.col("id") == F.col("_r"), "left").select(
        "id",
        F.round(suggestion_score(), 6).alias("puntaje"),
        F.col("_r").isNull().alias("fresh"),
        F.coalesce(F.col("artista_id") != F.lit(artist), F.lit(True)).alias("other_artist"),
        F.coalesce(F.col("album_id") != F.lit(album), F.lit(True)).alias("other_album"),
    )
    pool = first_filters(materialise(scored, "suggest"), ["fresh", "other_artist", "other_album"])
    top = pool.select("id", "puntaje").orderBy(F.desc("puntaje"), "id").limit(n)
    rank = F.row_number().over(Window.orderBy(F.desc("puntaje"), "id"))  # n rows
    draw = (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("id").cast("string"))), 1, 8), 16, 10).cast("double") + 1) / 4294967297.0
    return top.withColumn("_k", n + 1 - rank).withColumn("_d", -F.log(draw) / F.col("_k")).select("id", "puntaje", F.row_number().over(Window.orderBy("_d", "id")).alias("puesto"))


def recent_list(log: DataFrame, item: str, time: str, n: int) -> DataFrame:
    """The n last different items of a log, the newest first."""
    return log.filter(F.col(item).isNotNull()).groupBy(item).agg(F.max(time).alias("ultima")).orderBy(F.desc("ultima"), item).limit(n)


def lines_of(text: Column) -> Column:
    """The lines of a text that are not blank, trimmed."""
    return F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != "")


def synced_lyrics(text: Column) -> Column:
    """Lyrics with times, cleaned, or empty if any line has no valid time in front."""
    lines = F.filter(lines_of(text), lambda x: ~x.rlike(r"^\[[a-zA-Z]+:.*\]$"))
    stamp = r"^(?:\[\d{1,3}:[0-5]\d(?:[.:]\d{1,3})?\]\s*)+"
    ok = (F.size(lines) > 0) & F.forall(lines, lambda x: x.rlike(stamp))
    body = F.filter(lines, lambda x: F.trim(F.regexp_replace(x, stamp, "")) != "")
    return F.when(ok, F.array_join(F.transform(body, lambda x: collapse(x)), "\n")).otherwise("")


def document_like(text: Column) -> Column:
    """Whether a text reads like prose rather than verse: long lines, few lines with many words, or dense punctuation."""
    lines = lines_of(text)
    n = F.size(lines)
    total = F.aggregate(lines, F.lit(0), lambda s, x: s + F.length(x))
    longest = F.array_max(F.transform(lines, lambda x: F.length(x)))
    words = F.aggregate(lines, F.lit(0), lambda s, x: s + F.size(F.split(collapse(x), " ")))
    marks = F.aggregate(lines, F.lit(0), lambda s, x: s + F.length(F.regexp_replace(x, "[^.,;:!?]", "")))
    mean = total / n
    return F.when(n == 0, False).otherwise((longest > 180) | ((n <= 2) & (total > 160)) | ((n < 4) & (words > 55)) | (mean > 110) | ((marks / total > 0.12) & (mean > 70)))


def string_hash(text: Column) -> Column:
    """A 32-bit hash of a text: xor with each character, then times a prime."""
    return F.aggregate(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint")), F.lit(2166136261).cast("bigint"), lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF)))


def hash_colour(text: Column) -> Column:
    """struct(h, s, l): a colour derived from the hash."""
    h = string_hash(text)
    return F.struct((h % 360 / 360.0).alias("h"), (0.42 + F.shiftright(h, 8) % 20 / 100.0).alias("s"), (0.18 + F.shiftright(h, 16) % 9 / 100.0).alias("l"))


def asset_score(raw: Column, provider: Column, smallest_side: Column, least: int = 500) -> Column:
    """The score of a picture: what its source gave, a bonus by source, and one for its size."""
    bonus = F.when(provider == "theaudiodb", 0.10).when(provider == "deezer", 0.07).when(provider == "itunes", 0.05).when(provider == "wikipedia", 0.02).otherwise(0.0)
    return F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw + bonus + F.when(smallest_side >= least, 0.05).otherwise(-0.08))), 4)
