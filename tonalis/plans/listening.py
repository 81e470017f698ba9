"""Listening statistics: totals, most played, recency and the calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonalis.materialise import materialise
from tonalis.operators import listening as S
from tonalis.operators.library import LIBRARY, album_listing, in_library, number_rows
from tonalis.plans.registry import Registry
from tonalis.tables import Tables

query = Registry()

H = "(SELECT pista_id, count(*) AS n, max(reproducido_en) AS ultima FROM (SELECT DISTINCT id, pista_id, reproducido_en FROM historial WHERE pista_id IS NOT NULL) GROUP BY pista_id)"
WITH_PLAYS = f"(SELECT p.*, coalesce(h.n, p.veces_reproducida, 0) AS plays, h.ultima FROM pistas p LEFT JOIN {H} h ON h.pista_id = p.id)"
BRIDGE = "(SELECT sesion_id AS lista_id, pista_id, min(calculado_en) AS agregado FROM score_detalle GROUP BY 1, 2)"
AS_OF = "(SELECT max(reproducido_en) FROM historial)"


@query(f"SELECT id AS pista_id, titulo, plays, ultima FROM {WITH_PLAYS} WHERE estado = 'biblioteca' AND plays > 0 ORDER BY plays DESC, ultima DESC NULLS LAST, id LIMIT 10")
def top_tracks(t: Tables) -> DataFrame:
    """The most played tracks of the library."""
    p = S.with_plays(in_library(t.pistas).select("id", "titulo", "veces_reproducida"), t.historial).filter("plays > 0")
    return p.select(F.col("id").alias("pista_id"), "titulo", "plays", "ultima").orderBy(F.desc("plays"), F.desc_nulls_last("ultima"), "pista_id").limit(10)


@query(f"SELECT * FROM {H}")
def plays_per_track(t: Tables) -> DataFrame:
    return S.plays_per_track(t.historial)


@query(f"SELECT b.id, b.titulo, a.nombre AS artista, CAST(sum(h.n) AS BIGINT) AS plays FROM {H} h JOIN pistas p ON p.id = h.pista_id JOIN albums b ON b.id = p.album_id JOIN artistas a ON a.id = b.artista_id GROUP BY 1, 2, 3 ORDER BY plays DESC, b.id LIMIT 20")
def top_albums(t: Tables) -> DataFrame:
    """The most played albums; tracks outside the library count too."""
    b = t.albums.join(t.artistas.select(F.col("id").alias("artista_id"), F.col("nombre").alias("artista")), "artista_id")
    return S.album_plays(t.pistas, t.historial).join(b, F.col("album_id") == F.col("id")).select("id", "titulo", "artista", "plays").orderBy(F.desc("plays"), "id").limit(20)


@query(f"SELECT a.id, a.nombre, CAST(sum(h.n) AS BIGINT) AS plays, min_by(p.ruta_archivo, md5(CAST(p.id AS VARCHAR))) AS portada FROM {H} h JOIN pistas p ON p.id = h.pista_id JOIN artistas a ON a.id = p.artista_id GROUP BY 1, 2 ORDER BY plays DESC, a.id LIMIT 20")
def top_artists(t: Tables) -> DataFrame:
    """The most played artists, each with a repeatable pick of a path."""
    per = t.pistas.join(S.plays_per_track(t.historial), F.col("id") == F.col("pista_id")).filter("artista_id is not null").groupBy("artista_id").agg(F.sum("n").alias("plays"), F.min_by("ruta_archivo", S.hash_order("id")).alias("portada"))
    return t.artistas.join(per, F.col("id") == F.col("artista_id")).select("id", "nombre", "plays", "portada").orderBy(F.desc("plays"), "id").limit(20)


@query(f"SELECT d.id AS lista_id, d.prompt_original AS nombre, CAST(sum(h.n) AS BIGINT) AS plays FROM {BRIDGE} b JOIN {H} h ON h.pista_id = b.pista_id JOIN dj_sesiones d ON d.id = b.lista_id GROUP BY 1, 2 HAVING sum(h.n) > 0 ORDER BY plays DESC, d.id LIMIT 20")
def top_playlists(t: Tables) -> DataFrame:
    """Playlists by the plays of their tracks."""
    per = S.membership(t.score_detalle).join(S.plays_per_track(t.historial), "pista_id").groupBy("lista_id").agg(F.sum("n").alias("plays")).filter("plays > 0")
    return S.playlists(t.dj_sesiones).join(per, "lista_id").select("lista_id", "nombre", "plays").orderBy(F.desc("plays"), "lista_id").limit(20)


@query(f"SELECT id, titulo, greatest(ultima, ultimo_acceso) AS reciente FROM {WITH_PLAYS} WHERE estado = 'biblioteca' AND coalesce(ultima, ultimo_acceso) IS NOT NULL ORDER BY reciente DESC, id LIMIT 15")
def return_tracks(t: Tables) -> DataFrame:
    """Tracks to return to: by the last play or access, whichever is later."""
    p = S.with_plays(in_library(t.pistas).select("id", "titulo", "veces_reproducida", "ultimo_acceso"), t.historial)
    return p.select("id", "titulo", F.greatest("ultima", "ultimo_acceso").alias("reciente")).filter("reciente is not null").orderBy(F.desc("reciente"), "id").limit(15)


@query(f"""WITH c AS (SELECT b.lista_id, count(*) AS pistas, CAST(sum(p.favorita) AS BIGINT) AS favoritas, CAST(coalesce(sum(h.n), 0) AS BIGINT) AS plays FROM {BRIDGE} b JOIN pistas p ON p.id = b.pista_id LEFT JOIN {H} h ON h.pista_id = p.id GROUP BY 1)
SELECT d.id AS lista_id, d.prompt_original AS nombre, CAST(CASE WHEN d.estado = 'lista' AND plays > 0 THEN 1 WHEN d.estado = 'lista' THEN 2 WHEN d.estado = 'finalizada' AND favoritas > 0 THEN 3 WHEN d.estado = 'finalizada' THEN 4 ELSE 5 END AS INT) AS prioridad, pistas, plays
FROM dj_sesiones d JOIN c ON c.lista_id = d.id ORDER BY prioridad, plays DESC, pistas DESC, d.id LIMIT 12""")
def featured_playlists(t: Tables) -> DataFrame:
    """Playlists by a priority ladder, then plays, then size."""
    p = t.pistas.select(F.col("id").alias("pista_id"), "favorita").join(S.plays_per_track(t.historial), "pista_id", "left")
    c = S.membership(t.score_detalle).join(p, "pista_id").groupBy("lista_id").agg(F.count("*").alias("pistas"), F.sum("favorita").alias("favoritas"), F.coalesce(F.sum("n"), F.lit(0)).alias("plays"))
    rank = F.when((F.col("estado") == "lista") & (F.col("plays") > 0), 1).when(F.col("estado") == "lista", 2).when((F.col("estado") == "finalizada") & (F.col("favoritas") > 0), 3).when(F.col("estado") == "finalizada", 4).otherwise(5)
    return S.playlists(t.dj_sesiones).join(c, "lista_id").select("lista_id", "nombre", rank.alias("prioridad"), "pistas", "plays").orderBy("prioridad", F.desc("plays"), F.desc("pistas"), "lista_id").limit(12)


@query(f"""SELECT b.id, b.titulo, CAST(sum(p.favorita) AS BIGINT) AS favoritas, CAST(sum(p.favorita) * 100 + sum(p.plays) * 4 AS BIGINT) AS puntaje FROM albums b JOIN {WITH_PLAYS} p ON p.album_id = b.id AND p.estado = 'biblioteca'
GROUP BY 1, 2 HAVING sum(p.favorita) > 0 ORDER BY puntaje DESC, b.id LIMIT 12""")
def liked_albums(t: Tables) -> DataFrame:
    """Albums with favourites, by favourites x 100 + plays x 4."""
    p = S.with_plays(in_library(t.pistas).filter("album_id is not null").select("id", "album_id", "favorita", "veces_reproducida"), t.historial)
    per = p.groupBy("album_id").agg(F.sum("favorita").alias("favoritas"), (F.sum("favorita") * 100 + F.sum("plays") * 4).alias("puntaje")).filter("favoritas > 0")
    return t.albums.join(per, F.col("id") == F.col("album_id")).select("id", "titulo", "favoritas", "puntaje").orderBy(F.desc("puntaje"), "id").limit(12)


def _home_sql() -> str:
    q = query.sql
    parts = {
        "listas": f"SELECT 'lista' AS tipo, lista_id AS id, nombre FROM ({q['top_playlists']})", "pistas": f"SELECT 'pista', pista_id, titulo FROM ({q['top_tracks']})",
        "albumes": f"SELECT 'album', id, titulo FROM ({q['top_albums']})", "artistas": f"SELECT 'artista', id, nombre FROM ({q['top_artists']})",
    }
    rows = " UNION ALL ".join(f"SELECT *, {k} AS s, '{n}' AS fuente FROM ({x}) AS x{k}(tipo, id, nombre)" for k, (n, x) in enumerate(parts.items()))
    return f"""WITH a AS ({rows}), o AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY tipo, id ORDER BY s) = 1), p AS (SELECT *, s > 0 AS otra, row_number() OVER (PARTITION BY s > 0 ORDER BY md5('7|' || tipo || '|' || id), tipo, id) - 1 AS i FROM o)
SELECT tipo, id, nombre, fuente, CAST(CASE WHEN otra THEN 3 * (i // 2) + 1 + i % 2 ELSE i * 3 END AS INT) AS lugar FROM p WHERE i < 24 ORDER BY lugar LIMIT 24"""


@query(_home_sql())
def home_mix(t: Tables) -> DataFrame:
    """Four sources mixed: playlists, most played tracks, albums and artists."""
    parts = [
        ("listas", top_playlists(t).select(F.lit("lista").alias("tipo"), F.col("lista_id").alias("id"), "nombre")),
        ("pistas", top_tracks(t).select(F.lit("pista").alias("tipo"), F.col("pista_id").alias("id"), F.col("titulo").alias("nombre"))),
        ("albumes", top_albums(t).select(F.lit("album").alias("tipo"), "id", F.col("titulo").alias("nombre"))),
        ("artistas", top_artists(t).select(F.lit("artista").alias("tipo"), "id", "nombre")),
    ]
    return S.home_mix(parts, 24)


@query("""SELECT p.id, p.titulo FROM pistas p WHERE p.estado = 'biblioteca' AND coalesce(p.veces_reproducida, 0) = 0 AND NOT EXISTS (SELECT 1 FROM historial h WHERE h.pista_id = p.id)
ORDER BY md5(CAST(p.id AS VARCHAR)), p.id LIMIT 50""")
def never_played(t: Tables) -> DataFrame:
    """A repeatable pick of tracks that were never played."""
    return S.never_played(t.pistas, t.historial).select("id", "titulo").orderBy(S.hash_order("id"), "id").limit(50)


@query("SELECT count(*) AS n FROM pistas p WHERE p.estado = 'biblioteca' AND coalesce(p.veces_reproducida, 0) = 0 AND NOT EXISTS (SELECT 1 FROM historial h WHERE h.pista_id = p.id)")
def never_played_count(t: Tables) -> DataFrame:
    return S.never_played(t.pistas, t.historial).agg(F.count("*").alias("n"))


@query(f"SELECT id, titulo, plays FROM {WITH_PLAYS} WHERE estado = 'biblioteca' AND plays >= 1 ORDER BY plays, md5(CAST(id AS VARCHAR)), id LIMIT 50")
def least_played(t: Tables) -> DataFrame:
    p = S.with_plays(in_library(t.pistas).select("id", "titulo", "veces_reproducida"), t.historial).filter("plays >= 1")
    return p.select("id", "titulo", "plays").orderBy("plays", S.hash_order("id"), "id").limit(50)


_PLAYS = "(SELECT DISTINCT id, pista_id, reproducido_en, duracion_seg, completada, titulo_snap, artista_snap FROM historial)"


@query(f"SELECT CAST(extract(hour FROM reproducido_en) AS INT) AS hora, count(*) AS n FROM {_PLAYS} GROUP BY 1")
def plays_by_hour(t: Tables) -> DataFrame:
    return S.distinct_plays(t.historial).groupBy(F.hour("reproducido_en").alias("hora")).agg(F.count("*").alias("n"))


@query(f"""WITH a AS (SELECT *, {AS_OF} AS hoy FROM {_PLAYS}) SELECT (SELECT hora FROM (SELECT CAST(extract(hour FROM reproducido_en) AS INT) AS hora, count(*) AS n FROM a GROUP BY 1 ORDER BY n DESC, hora LIMIT 1)) AS hora_pico,
(SELECT anio FROM (SELECT CAST(extract(year FROM reproducido_en) AS INT) AS anio, count(*) AS n FROM a GROUP BY 1 ORDER BY n DESC, anio LIMIT 1)) AS anio_pico,
(SELECT count(DISTINCT CAST(reproducido_en AS DATE)) FROM a WHERE date_trunc('month', reproducido_en) = date_trunc('month', hoy)) AS dias_activos_mes""")
def profile_peaks(t: Tables) -> DataFrame:
    """Peak hour, peak year, and days with a play in the month of the last play."""
    # one pass over the log; the rest reads a row per hour of each day
    per = materialise(S.distinct_plays(t.historial).groupBy(F.to_date("reproducido_en").alias("dia"), F.hour("reproducido_en").alias("hora")).agg(F.count("*").alias("n")), "hours")
    peak = lambda k: per.groupBy(k.alias("k")).agg(F.sum("n").alias("n")).agg(F.max_by("k", F.struct("n", -F.col("k")))).scalar()
    last = per.agg(F.max("dia")).scalar()
    month = per.filter(F.trunc("dia", "month") == F.trunc(last, "month")).agg(F.countDistinct("dia").alias("dias_activos_mes"))
    return month.select(peak(F.col("hora")).alias("hora_pico"), peak(F.year("dia")).alias("anio_pico"), "dias_activos_mes")


@query(f"SELECT p.genero, count(*) AS n FROM {_PLAYS} h JOIN pistas p ON p.id = h.pista_id WHERE trim(coalesce(p.genero, '')) <> '' GROUP BY 1 ORDER BY n DESC, p.genero LIMIT 6")
def genres_ever(t: Tables) -> DataFrame:
    h = S.distinct_plays(t.historial).groupBy("pista_id").agg(F.count("*").alias("n"))
    return h.join(t.pistas.select(F.col("id").alias("pista_id"), "genero"), "pista_id").filter("trim(coalesce(genero, '')) <> ''").groupBy("genero").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "genero").limit(6)


@query(f"SELECT coalesce(h.artista_snap, '') AS artista, count(*) AS n FROM {_PLAYS} h WHERE CAST(h.reproducido_en AS DATE) = CAST({AS_OF} AS DATE) GROUP BY 1 ORDER BY n DESC, artista LIMIT 3")
def artists_today(t: Tables) -> DataFrame:
    """The three artists most played on the day of the last play."""
    day = S.distinct_plays(t.historial).filter(F.to_date("reproducido_en") == F.to_date(S.as_of(t.historial)))
    return day.groupBy(F.coalesce("artista_snap", F.lit("")).alias("artista")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "artista").limit(3)


@query(f"SELECT strftime(reproducido_en, '%Y-%m') AS mes, CAST(reproducido_en AS DATE) AS dia, count(*) AS plays, CAST(sum(completada) AS BIGINT) AS completas, round(sum(CASE WHEN duracion_seg > 0 THEN duracion_seg ELSE 0 END), 1) AS segundos FROM {_PLAYS} GROUP BY 1, 2")
def activity_by_day(t: Tables) -> DataFrame:
    """Plays, complete plays and seconds per day; negative durations count as none."""
    h = t.historial.dropDuplicates()
    return h.groupBy(F.date_format("reproducido_en", "yyyy-MM").alias("mes"), F.to_date("reproducido_en").alias("dia")).agg(F.count("*").alias("plays"), F.sum("completada").alias("completas"), F.round(F.sum(F.when(F.col("duracion_seg") > 0, F.col("duracion_seg")).otherwise(0.0)), 1).alias("segundos"))


@query(f"""SELECT count(*) AS plays, CAST(sum(completada) AS BIGINT) AS completas, round(sum(CASE WHEN duracion_seg > 0 THEN duracion_seg ELSE 0 END), 1) AS segundos, count(DISTINCT pista_id) AS pistas, count(DISTINCT artista_snap) AS artistas, count(*) FILTER (pista_id IS NULL) AS sin_pista FROM {_PLAYS}""")
def listening_totals(t: Tables) -> DataFrame:
    return t.historial.dropDuplicates().agg(F.count("*").alias("plays"), F.sum("completada").alias("completas"), F.round(F.sum(F.when(F.col("duracion_seg") > 0, F.col("duracion_seg")).otherwise(0.0)), 1).alias("segundos"), F.countDistinct("pista_id").alias("pistas"), F.countDistinct("artista_snap").alias("artistas"), F.count_if(F.col("pista_id").isNull()).alias("sin_pista"))


@query(f"SELECT h.id, coalesce(p.titulo, h.titulo_snap) AS titulo, h.reproducido_en FROM {_PLAYS} h LEFT JOIN pistas p ON p.id = h.pista_id ORDER BY h.reproducido_en DESC, h.id LIMIT 25")
def recent_plays(t: Tables) -> DataFrame:
    """The last plays, with the snapshot's title where the track is gone."""
    last = t.historial.dropDuplicates().orderBy(F.desc("reproducido_en"), "id").limit(25)  # the join can't change which are last
    return last.join(t.pistas.select(F.col("id").alias("pista_id"), "titulo"), "pista_id", "left").select("id", F.coalesce("titulo", "titulo_snap").alias("titulo"), "reproducido_en")


@query(f"SELECT b.lista_id, count(*) AS pistas, round(sum(p.duracion_seg), 2) AS duracion, count(DISTINCT p.artista_id) AS artistas, CAST(sum(p.favorita) AS BIGINT) AS favoritas, CAST(coalesce(sum(h.n), 0) AS BIGINT) AS plays FROM {BRIDGE} b JOIN pistas p ON p.id = b.pista_id LEFT JOIN {H} h ON h.pista_id = p.id GROUP BY 1")
def playlist_stats(t: Tables) -> DataFrame:
    p = t.pistas.select(F.col("id").alias("pista_id"), "duracion_seg", "artista_id", "favorita").join(S.plays_per_track(t.historial), "pista_id", "left")
    return S.membership(t.score_detalle).join(p, "pista_id").groupBy("lista_id").agg(F.count("*").alias("pistas"), F.round(F.sum("duracion_seg"), 2).alias("duracion"), F.countDistinct("artista_id").alias("artistas"), F.sum("favorita").alias("favoritas"), F.coalesce(F.sum("n"), F.lit(0)).alias("plays"))


@query(f"SELECT d.id AS lista_id, d.prompt_original AS nombre, lower(d.motor_version) AS subtipo, coalesce(c.pistas, 0) AS pistas FROM dj_sesiones d LEFT JOIN (SELECT lista_id, count(*) AS pistas FROM {BRIDGE} GROUP BY 1) c ON c.lista_id = d.id")
def playlist_list(t: Tables) -> DataFrame:
    c = S.membership(t.score_detalle).groupBy("lista_id").agg(F.count("*").alias("pistas"))
    return S.playlists(t.dj_sesiones).join(c, "lista_id", "left").select("lista_id", "nombre", "subtipo", F.coalesce("pistas", F.lit(0)).alias("pistas"))


@query(f"SELECT b.lista_id, bool_or(p.favorita = 1) AS con_favorita, bool_or(p.artista_id = 1) AS con_artista_1, max(CASE WHEN p.genero = 'folk' THEN 1 ELSE 0 END) AS con_folk FROM {BRIDGE} b JOIN pistas p ON p.id = b.pista_id GROUP BY 1")
def playlists_containing(t: Tables) -> DataFrame:
    """Whether a playlist holds a track that ...: boolean aggregates."""
    p = t.pistas.select(F.col("id").alias("pista_id"), "favorita", "artista_id", "genero")
    return S.membership(t.score_detalle).join(p, "pista_id").groupBy("lista_id").agg(F.bool_or(F.col("favorita") == 1).alias("con_favorita"), F.bool_or(F.col("artista_id") == 1).alias("con_artista_1"), F.max(F.when(F.col("genero") == "folk", 1).otherwise(0)).alias("con_folk"))


@query(f"SELECT lista_id, pista_id, row_number() OVER (PARTITION BY lista_id ORDER BY agregado, pista_id) AS posicion FROM {BRIDGE}")
def playlist_tracks(t: Tables) -> DataFrame:
    """The tracks of every playlist in order, numbered without holding a playlist in one task."""
    return number_rows(S.membership(t.score_detalle), ["lista_id"], [F.asc("agregado"), F.asc("pista_id")]).select("lista_id", "pista_id", "posicion")


@query(f"SELECT p.artista_id, count(*) AS pistas, CAST(sum(p.favorita) AS BIGINT) AS favoritas, CAST(sum(p.plays) AS BIGINT) AS plays FROM {WITH_PLAYS} p WHERE p.estado = 'biblioteca' AND p.artista_id IS NOT NULL GROUP BY 1")
def artist_counts(t: Tables) -> DataFrame:
    p = S.with_plays(in_library(t.pistas).filter("artista_id is not null").select("id", "artista_id", "favorita", "veces_reproducida"), t.historial)
    return p.groupBy("artista_id").agg(F.count("*").alias("pistas"), F.sum("favorita").alias("favoritas"), F.sum("plays").alias("plays"))


@query("SELECT a.id, a.nombre, b.albumes FROM artistas a JOIN (SELECT artista_id, count(DISTINCT CASE WHEN anio IS NOT NULL THEN id END) AS albumes FROM albums GROUP BY 1) b ON b.artista_id = a.id")
def dated_albums(t: Tables) -> DataFrame:
    """A conditional distinct count."""
    b = t.albums.groupBy("artista_id").agg(F.countDistinct(F.when(F.col("anio").isNotNull(), F.col("id"))).alias("albumes"))
    return t.artistas.join(b, F.col("id") == F.col("artista_id")).select("id", "nombre", "albumes")


@query("SELECT id, min(ruta_archivo) AS primera, count(*) AS n FROM (SELECT album_id AS id, ruta_archivo FROM pistas WHERE album_id IS NOT NULL) GROUP BY id")
def first_path(t: Tables) -> DataFrame:
    return t.pistas.filter("album_id is not null").groupBy(F.col("album_id").alias("id")).agg(F.min("ruta_archivo").alias("primera"), F.count("*").alias("n"))


@query(f"SELECT id, titulo, anio, pistas FROM (SELECT b.*, count(p.id) AS pistas FROM albums b JOIN pistas p ON p.album_id = b.id AND p.estado = '{LIBRARY}' GROUP BY ALL) WHERE pistas >= 3")
def large_albums(t: Tables) -> DataFrame:
    """A condition on an aggregate."""
    return album_listing(t.artistas, t.albums, t.pistas).filter("pistas >= 3").select("id", "titulo", "anio", "pistas")
