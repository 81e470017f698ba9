"""Computations behind an interface."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonalis.functions.vectors import circular_mean
from tonalis.operators import interface as V
from tonalis.operators.library import in_library
from tonalis.plans.registry import Registry
from tonalis.tables import Tables

query = Registry()

_SCORE = """least(3.0, coalesce(veces_reproducida, 0) * 0.12) + CASE WHEN favorita = 1 THEN 1.2 ELSE 0 END + least(1.0, greatest(0.0, coalesce(bitrate_kbps, 0) - 160.0) / 128.0)
+ CASE WHEN coalesce(duracion_seg, 0) BETWEEN 45 AND 540 THEN 0.4 WHEN duracion_seg > 0 AND duracion_seg < 30 THEN -1.0 WHEN duracion_seg > 900 THEN -2.0 ELSE 0 END + CASE WHEN ultimo_acceso IS NOT NULL THEN -2.5 ELSE 0 END"""


@query(f"SELECT id, round(CAST({_SCORE} AS DOUBLE), 8) AS puntaje FROM pistas")
def suggestion_scores(t: Tables) -> DataFrame:
    return t.pistas.select("id", F.round(V.suggestion_score(), 8).alias("puntaje"))


@query(f"""WITH rec AS (SELECT pista_id FROM (SELECT pista_id, max(reproducido_en) AS u FROM historial WHERE pista_id IS NOT NULL GROUP BY 1 ORDER BY u DESC, pista_id LIMIT 30)), cur AS (SELECT artista_id, album_id FROM pistas WHERE estado = 'biblioteca' AND id = 1),
sc AS (SELECT id, round(CAST({_SCORE} AS DOUBLE), 6) AS puntaje, id NOT IN (SELECT pista_id FROM rec) AS fresh, coalesce(artista_id <> (SELECT artista_id FROM cur), true) AS oa, coalesce(album_id <> (SELECT album_id FROM cur), true) AS ob FROM pistas WHERE estado = 'biblioteca' AND id <> 1),
f1 AS (SELECT * FROM sc WHERE fresh OR NOT EXISTS (SELECT 1 FROM sc WHERE fresh)), f2 AS (SELECT * FROM f1 WHERE oa OR NOT EXISTS (SELECT 1 FROM f1 WHERE oa)), f3 AS (SELECT * FROM f2 WHERE ob OR NOT EXISTS (SELECT 1 FROM f2 WHERE ob)),
tp AS (SELECT id, puntaje, 41 - row_number() OVER (ORDER BY puntaje DESC, id) AS k FROM f3 ORDER BY puntaje DESC, id LIMIT 40), dr AS (SELECT id, puntaje, -ln((CAST('0x' || substr(md5('7|' || id), 1, 8) AS BIGINT) + 1) / 4294967297.0) / k AS d FROM tp)
SELECT id, puntaje, CAST(row_number() OVER (ORDER BY d, id) AS INT) AS puesto FROM dr""")
def suggestion_draw(t: Tables) -> DataFrame:
    """The candidates for the track after the first one, with a weighted draw."""
    recent = V.recent_list(t.historial, "pista_id", "reproducido_en", 30)
    return V.suggest(in_library(t.pistas), recent, 1)


@query("SELECT pista_id, max(reproducido_en) AS ultima FROM historial WHERE pista_id IS NOT NULL GROUP BY 1 ORDER BY ultima DESC, pista_id LIMIT 32")
def recent_list(t: Tables) -> DataFrame:
    return V.recent_list(t.historial, "pista_id", "reproducido_en", 32)


_L = r"list_filter(list_transform(regexp_split_to_array(text, '\r\n|\r|\n'), lambda x: trim(x)), lambda x: x <> '')"


@query(rf"""WITH l AS (SELECT doc_id, {_L} AS l FROM documents), n AS (SELECT doc_id, l, len(l) AS n, coalesce(list_sum(list_transform(l, lambda x: length(x))), 0) AS total, list_max(list_transform(l, lambda x: length(x))) AS mayor,
 list_sum(list_transform(l, lambda x: len(string_split(trim(regexp_replace(x, '[\s\p{{Z}}]+', ' ', 'g')), ' ')))) AS palabras, list_sum(list_transform(l, lambda x: length(regexp_replace(x, '[^.,;:!?]', '', 'g')))) AS marcas FROM l)
SELECT doc_id, CASE WHEN n = 0 THEN false ELSE mayor > 180 OR (n <= 2 AND total > 160) OR (n < 4 AND palabras > 55) OR total / n > 110 OR (marcas / total > 0.12 AND total / n > 70) END AS prosa FROM n""")
def document_like(t: Tables) -> DataFrame:
    """Which documents read like prose."""
    return t.documents.select("doc_id", V.document_like(F.col("text")).alias("prosa"))


_STAMP = r"^(?:\[[0-9]{1,3}:[0-5][0-9](?:[.:][0-9]{1,3})?\]\s*)+"


@query(rf"""WITH l AS (SELECT doc_id, text, {_L} AS l FROM documents), m AS (SELECT doc_id, CASE WHEN length(text) % 3 = 0 THEN l ELSE list_transform(l, lambda x, i: '[00:' || lpad(CAST((i - 1) % 60 AS VARCHAR), 2, '0') || '.00]' || x) END AS l FROM l),
f AS (SELECT doc_id, list_filter(l, lambda x: NOT regexp_full_match(x, '\[[a-zA-Z]+:.*\]')) AS l FROM m)
SELECT doc_id, CASE WHEN len(l) > 0 AND len(list_filter(l, lambda x: NOT regexp_matches(x, '{_STAMP}'))) = 0
 THEN coalesce(array_to_string(list_transform(list_filter(l, lambda x: trim(regexp_replace(x, '{_STAMP}', '')) <> ''), lambda x: trim(regexp_replace(x, '[\s\p{{Z}}]+', ' ', 'g'))), chr(10)), '') ELSE '' END AS letra FROM f""")
def synced_lyrics(t: Tables) -> DataFrame:
    """Documents as timed lyrics: a time is put before each line, every third document loses it."""
    timed = F.array_join(F.transform(V.lines_of(F.col("text")), lambda x, i: F.concat(F.lit("[00:"), F.lpad(F.pmod(i, F.lit(60)).cast("string"), 2, "0"), F.lit(".00]"), x)), "\n")
    return t.documents.select("doc_id", V.synced_lyrics(F.when(F.length("text") % 3 == 0, F.col("text")).otherwise(timed)).alias("letra"))


@query("SELECT artista_id, round((atan2(sum(sin(valence * 6.283185307179586) * energy), sum(cos(valence * 6.283185307179586) * energy)) / 6.283185307179586 + 1) % 1, 6) AS tono FROM pista_candidata WHERE artista_id IS NOT NULL AND valence IS NOT NULL AND NOT isnan(valence) AND energy > 0 AND NOT isnan(energy) GROUP BY 1 HAVING count(*) >= 2")
def circular_hues(t: Tables) -> DataFrame:
    """The weighted mean of values on a circle."""
    rows = t.pista_candidata.filter("artista_id is not null and valence is not null and not isnan(valence) and energy > 0 and not isnan(energy)")
    return rows.groupBy("artista_id").agg(F.round(circular_mean(F.col("valence"), F.col("energy")), 6).alias("tono"), F.count("*").alias("_n")).filter("_n >= 2").drop("_n")


@query("""WITH RECURSIVE s AS (SELECT id, ruta_archivo AS r, 1 AS k, 2166136261::BIGINT AS h FROM albums JOIN (SELECT album_id, min(titulo_slug) AS ruta_archivo FROM (SELECT id AS album_id, titulo_slug FROM albums) GROUP BY 1) ON album_id = id
UNION ALL SELECT id, r, k + 1, ((xor(h, unicode(r[k])::BIGINT) * 16777619::BIGINT) & 4294967295::BIGINT) FROM s WHERE k <= length(r))
SELECT id, h, round(h % 360 / 360.0::DOUBLE, 6) AS tono FROM s WHERE k = length(r) + 1""")
def hash_colours(t: Tables) -> DataFrame:
    """A hash and a hue for every album, from the code points of its slug."""
    return t.albums.select("id", V.string_hash(F.col("titulo_slug")).alias("h"), F.round(V.hash_colour(F.col("titulo_slug"))["h"], 6).alias("tono"))


@query("""WITH c AS (SELECT id, CASE id % 5 WHEN 0 THEN 'theaudiodb' WHEN 1 THEN 'deezer' WHEN 2 THEN 'itunes' WHEN 3 THEN 'wikipedia' ELSE 'otro' END AS p, (id * 37 % 100) / 100.0::DOUBLE AS raw, id * 13 % 1000 AS lado FROM albums)
SELECT id, round_even(least(1.0, greatest(0.0, raw + CASE p WHEN 'theaudiodb' THEN 0.10 WHEN 'deezer' THEN 0.07 WHEN 'itunes' THEN 0.05 WHEN 'wikipedia' THEN 0.02 ELSE 0 END + CASE WHEN lado >= 500 THEN 0.05 ELSE -0.08 END)), 4) AS puntaje FROM c""")
def asset_scores(t: Tables) -> DataFrame:
    """Scores of pictures, here with a source, a score and a size derived from the id."""
    p = F.element_at(F.array(*[F.lit(x) for x in ("theaudiodb", "deezer", "itunes", "wikipedia", "otro")]), (F.col("id") % 5 + 1).cast("int"))
    return t.albums.select("id", V.asset_score((F.col("id") * 37 % 100) / 100.0, p, F.col("id") * 13 % 1000).alias("puntaje"))


@query("""SELECT user_id, CAST(sum(greatest(0, n - e - s)) AS BIGINT) AS duplicados, CAST(sum(n) AS BIGINT) AS total FROM (SELECT user_id, CAST(ts AS DATE) AS dia, count(*) AS n, count(*) FILTER (event_type = 'error') AS e, count(*) FILTER (event_type = 'signup') AS s FROM events GROUP BY 1, 2) GROUP BY 1""")
def import_totals(t: Tables) -> DataFrame:
    """Totals of runs with what remains after the known outcomes, floored at 0 per run."""
    per = t.events.groupBy("user_id", F.to_date("ts").alias("dia")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("e"), F.count_if(F.col("event_type") == "signup").alias("s"))
    return per.groupBy("user_id").agg(F.sum(F.greatest(F.lit(0), F.col("n") - F.col("e") - F.col("s"))).alias("duplicados"), F.sum("n").alias("total"))
