"""Listings of the library: artists, albums, tracks and playlists with their counts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonalis.materialise import materialise, task_count

LIBRARY = "biblioteca"

# Release types of each album group; any other type belongs to the last group.
ALBUM_GROUPS = {"albums": ("album",), "singles_y_ep": ("single", "ep")}
OTHER_GROUP = "otros"


def in_library(tracks: DataFrame) -> DataFrame:
    return tracks.filter(F.col("estado") == LIBRARY)


def album_group(kind: Column) -> Column:
    """The group of a release type, without regard to case."""
    k, out = F.lower(F.trim(kind)), F.lit(OTHER_GROUP)
    for group, types in reversed(ALBUM_GROUPS.items()):
        out = F.when(k.isin(*types), group).otherwise(out)
    return out


def contains_text(term: str, *columns: str) -> Column:
    """Any of the columns holds the term literally, without regard to case."""
    out = F.lit(False)
    for c in columns:
        out |= F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(term.lower()))
    return out


def clamp_limit(n: int, most: int) -> int:
    return max(0, min(int(n), most))


def artist_listing(artists: DataFrame, albums: DataFrame, tracks: DataFrame, *, text: str | None = None) -> DataFrame:
    """Artists with a track in the library: their albums by group, tracks, seconds, and the seconds as a join with the albums
    multiplies them (``duracion_multiplicada``: kept beside the right sum).

    Children are aggregated before the join, so nothing is multiplied and each side is shuffled once by artist.
    """
    live = in_library(tracks).filter(F.col("artista_id").isNotNull())
    per_track = live.groupBy("artista_id").agg(F.count("*").alias("pistas"), F.sum(F.coalesce("duracion_seg", F.lit(0.0))).alias("duracion"))
    group = album_group(F.col("tipo"))
    per_album = albums.groupBy("artista_id").agg(F.count("*").alias("albumes"), *[F.count_if(group == g).alias(g) for g in (*ALBUM_GROUPS, OTHER_GROUP)])
    out = artists.join(per_track, artists["id"] == per_track["artista_id"]).drop("artista_id").join(per_album, artists["id"] == per_album["artista_id"], "left").drop("artista_id")
    if text:
        own = live.filter(contains_text(text, "titulo", "artista_nombre", "album_titulo", "genero")).select("artista_id").distinct()
        hit = out.join(own, out["id"] == own["artista_id"], "left").withColumn("_t", F.col("artista_id").isNotNull()).drop("artista_id")
        out = hit.filter(F.col("_t") | contains_text(text, "nombre")).drop("_t")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("id", "nombre", zero("albumes").alias("albumes"), *[zero(g).alias(g) for g in (*ALBUM_GROUPS, OTHER_GROUP)], "pistas", F.round("duracion", 2).alias("duracion"), F.round(F.col("duracion") * F.greatest(zero("albumes"), F.lit(1)), 2).alias("duracion_multiplicada"))


def album_listing(artists: DataFrame, albums: DataFrame, tracks: DataFrame, predicates: Sequence[Column] = ()) -> DataFrame:
    """Albums with a track in the library: artist, group, tracks, seconds and favourites; ``predicates`` apply to the albums."""
    live = in_library(tracks).filter(F.col("album_id").isNotNull())
    per = live.groupBy("album_id").agg(F.count("*").alias("pistas"), F.sum(F.coalesce("duracion_seg", F.lit(0.0))).alias("duracion"), F.sum("favorita").alias("favoritas"), F.max("indexado_en").alias("ultimo_indexado"))
    chosen = albums
    for p in predicates:
        chosen = chosen.filter(p)
    a = chosen.join(artists.select(F.col("id").alias("artista_id"), F.col("nombre").alias("artista")), "artista_id")
    return a.join(per, F.col("id") == F.col("album_id")).select("id", "titulo", "artista_id", "artista", album_group(F.col("tipo")).alias("grupo"), "anio", "pistas", F.round("duracion", 2).alias("duracion"), "favoritas", "ultimo_indexado")


def all_of(predicates: Sequence[Column]) -> Column:
    """The conjunction of any number of predicates; true without one."""
    out = F.lit(True)
    for p in predicates:
        out &= p
    return out


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0, most: int = 500) -> DataFrame:
    """A page of the ordered rows; the order should end in a key so that pages don't overlap."""
    out = df.orderBy(*order)
    return (out.offset(offset) if offset else out).limit(clamp_limit(limit, most))


def number_rows(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "posicion") -> DataFrame:
    """Positions 1..n within each group, whatever its size.

    A window over the group would hold a hot group in one task. Here the rows are range-partitioned by group and order, numbered
    inside each piece, and the counts of the pieces before are added.
    """
    cut = materialise(df.repartitionByRange(task_count(df.sparkSession), *[F.col(g) for g in group], *order).withColumn("_piece", F.spark_partition_id()), "numbered")
    before = Window.partitionBy(*group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    start = cut.groupBy(*group, "_piece").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    keys = [*group, "_piece"]
    return cut.withColumn("_inside", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).join(start, keys).withColumn(name, (F.col("_inside") + F.col("_start")).cast("bigint")).drop("_piece", "_inside", "_start")


def sort_key(c: Column, folded: Column) -> Column:
    """A key that sorts digits, then Latin letters, then other scripts, then blanks."""
    bucket = F.when(c.isNull() | (F.trim(c) == ""), "3").when(folded.rlike("^[0-9]"), "0").when(folded.rlike("^[a-z]"), "1").otherwise("2")
    return F.concat(bucket, F.coalesce(folded, F.lit("")))


def free_names(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """(nombre, libre): each wanted name itself if it is free, else with the smallest number from 2 on that makes it free.

    Both tables have ``nombre``. Only taken names that are a wanted one with a number are ranked, so a window holds the copies of one name.
    """
    parts = r"^(.*) ([1-9][0-9]{0,17})$"
    names = taken.select("nombre").filter("nombre is not null").distinct()
    numbered = names.select(F.regexp_extract("nombre", parts, 1).alias("nombre"), F.expr("try_cast(regexp_extract(nombre, '^(.*) ([1-9][0-9]{0,17})$', 2) as bigint)").alias("k")).filter("k >= 2")
    want = wanted.select("nombre").filter("nombre is not null").distinct()
    ranked = want.join(numbered, "nombre").withColumn("_due", F.row_number().over(Window.partitionBy("nombre").orderBy("k")) + 1)
    first = ranked.groupBy("nombre").agg(F.coalesce(F.min(F.when(F.col("k") != F.col("_due"), F.col("_due"))), F.max("k") + 1).alias("n"))
    j = want.join(names.withColumn("_taken", F.lit(True)), "nombre", "left").join(first, "nombre", "left")
    return j.select("nombre", F.when(F.col("_taken").isNull(), F.col("nombre")).otherwise(F.concat_ws(" ", "nombre", F.coalesce("n", F.lit(2)).cast("string"))).alias("libre"))


def track_order(name: str, key: Callable[[str], Column]) -> list[Column]:
    """The sort keys of a track listing by name, ending with the id; unknown names sort by title. ``key`` gives the sort key of a text column."""
    number, zero = F.coalesce("track_number", F.lit(9999)), F.lit(0)
    title, artist, album = key("titulo"), key("artista_nombre"), key("album_titulo")
    year, length, plays = F.coalesce("anio", zero), F.coalesce("duracion_seg", F.lit(0.0)), F.coalesce("veces_reproducida", zero)
    table = {
        "titulo": [title.asc(), artist.asc()], "titulo_desc": [title.desc(), artist.asc()], "artista": [artist.asc(), album.asc(), number.asc()], "artista_desc": [artist.desc(), album.asc(), number.asc()],
        "album": [album.asc(), number.asc(), title.asc()], "album_desc": [album.desc(), number.asc(), title.asc()], "anio": [year.desc(), title.asc()], "anio_asc": [year.asc(), title.asc()],
        "duracion": [length.desc(), title.asc()], "duracion_asc": [length.asc(), title.asc()], "reproducida": [plays.desc(), title.asc()], "reproducida_asc": [plays.asc(), title.asc()],
        "reciente": [F.desc_nulls_last("ultimo_acceso"), F.desc_nulls_last("actualizado_en")], "reciente_asc": [F.asc_nulls_first("ultimo_acceso"), F.asc_nulls_first("actualizado_en")],
    }
    return [*table.get(name, [title.asc()]), F.asc("id")]


def track_page(tracks: DataFrame, order: str, key: Callable[[str], Column], limit: int, offset: int = 0, predicates: Sequence[Column] = ()) -> DataFrame:
    """A page of the library in one of the orders of :func:`track_order`: the sort stops at the page (top-k), nothing is sorted whole."""
    return page(in_library(tracks).filter(all_of(predicates)), track_order(order, key), limit, offset)


def listing_order(name: str, key: Callable[[str], Column], names: dict[str, str], extra: dict[str, list[Column]] | None = None) -> list[Column]:
    """The sort keys of a listing by the name of its order, ending with the id: ``names`` maps an order to the column that leads it (texts by ``key``,
    numbers falling), each with ``_asc`` or ``_desc`` as its reverse; ``extra`` holds orders of their own. Unknown names take the first text."""
    texts = [c for c in names.values() if c in ("titulo", "nombre", "artista")]
    tie = key(texts[0])
    base, _, turn = name.rpartition("_")
    lead = names.get(name, names.get(base if turn in ("asc", "desc") else name))
    if extra and name in extra:
        return [*extra[name], F.asc("id")]
    if lead is None:
        return [tie.asc(), F.asc("id")]
    if lead in ("titulo", "nombre", "artista"):
        return [key(lead).desc() if turn == "desc" else key(lead).asc(), F.asc("id")]
    value = F.coalesce(F.col(lead), F.lit(0))
    return [value.asc() if turn == "asc" else value.desc(), tie.asc(), F.asc("id")]
