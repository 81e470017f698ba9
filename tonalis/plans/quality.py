"""Audits of the library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonalis.operators import quality as A
from tonalis.operators.library import in_library
from tonalis.plans.listening import H
from tonalis.plans.registry import Registry
from tonalis.tables import Tables

query = Registry()


@query("""SELECT coalesce(nullif(trim(mb_recording_id), ''), nullif(trim(isrc), ''), lower(titulo) || '::' || lower(artista_nombre)) AS clave, count(*) AS n, min(id) AS primera FROM pistas GROUP BY 1 HAVING count(*) > 1""")
def audit_duplicates(t: Tables) -> DataFrame:
    return A.duplicate_keys(t.pistas)


@query("""SELECT p.id, CASE WHEN c.id IS NULL THEN 'falta' ELSE 'viejo' END AS causa FROM pistas p LEFT JOIN pista_candidata c ON c.id = p.id WHERE c.id IS NULL OR c.analizado_en < p.actualizado_en""")
def audit_stale_features(t: Tables) -> DataFrame:
    return A.stale(t.pistas, t.pista_candidata)


@query("""SELECT id, CASE WHEN mood_happy IS NULL OR mood_sad IS NULL THEN 'falta' ELSE 'completo' END AS profundo FROM pista_candidata""")
def audit_deep_features(t: Tables) -> DataFrame:
    return t.pista_candidata.select("id", F.when(F.col("mood_happy").isNull() | F.col("mood_sad").isNull(), "falta").otherwise("completo").alias("profundo"))


@query("""SELECT coalesce(nullif(trim(lower(mode)), ''), 'sin_modo') AS estado, count(*) AS n FROM pista_candidata GROUP BY 1""")
def audit_status_counts(t: Tables) -> DataFrame:
    return t.pista_candidata.groupBy(F.coalesce(F.nullif(F.trim(F.lower("mode")), F.lit("")), F.lit("sin_modo")).alias("estado")).agg(F.count("*").alias("n"))


@query("""SELECT (SELECT count(*) FROM pistas) AS pistas, (SELECT count(*) FROM pistas p WHERE NOT EXISTS (SELECT 1 FROM pista_candidata c WHERE c.id = p.id)) AS sin_rasgos,
(SELECT count(*) FROM pistas p WHERE NOT EXISTS (SELECT 1 FROM ejes_pista e WHERE e.pista_id = p.id AND e.valores IS NOT NULL)) AS sin_ejes, (SELECT count(*) FROM pistas WHERE artista_id IS NULL) AS sin_artista,
(SELECT count(*) FROM pistas WHERE album_id IS NULL) AS sin_album, (SELECT count(*) FROM pistas WHERE isrc IS NULL AND mb_recording_id IS NULL AND hash_sha256 IS NULL) AS sin_identidad""")
def audit_recovery(t: Tables) -> DataFrame:
    """What is missing, as one row of counters."""
    p = t.pistas
    base = p.agg(F.count("*").alias("pistas"), F.count_if(F.col("artista_id").isNull()).alias("sin_artista"), F.count_if(F.col("album_id").isNull()).alias("sin_album"), F.count_if(F.col("isrc").isNull() & F.col("mb_recording_id").isNull() & F.col("hash_sha256").isNull()).alias("sin_identidad"))
    features = A.missing(p, t.pista_candidata, "id", "id").agg(F.count("*")).scalar()
    axes = A.missing(p, t.ejes_pista.filter("valores is not null"), "id", "pista_id").agg(F.count("*")).scalar()
    return base.select("pistas", features.alias("sin_rasgos"), axes.alias("sin_ejes"), "sin_artista", "sin_album", "sin_identidad")


@query("SELECT b.id, b.titulo FROM albums b LEFT JOIN pistas p ON p.album_id = b.id WHERE p.id IS NULL")
def audit_empty_albums(t: Tables) -> DataFrame:
    """Albums without a track: assets that nothing refers to."""
    return A.missing(t.albums, t.pistas, "id", "album_id").select("id", "titulo")


@query("SELECT DISTINCT h.pista_id FROM historial h LEFT JOIN pistas p ON p.id = h.pista_id WHERE h.pista_id IS NOT NULL AND p.id IS NULL")
def audit_broken_references(t: Tables) -> DataFrame:
    return A.missing(t.historial.select("pista_id").filter("pista_id is not null").distinct(), t.pistas, "pista_id", "id")


@query("SELECT id FROM artistas WHERE mb_artist_id IS NULL UNION SELECT -id FROM albums WHERE mb_release_id IS NULL")
def audit_missing_manifests(t: Tables) -> DataFrame:
    """Entities without an outside identifier, albums with a negative number."""
    a = t.artistas.filter("mb_artist_id is null").select("id")
    return a.unionByName(t.albums.filter("mb_release_id is null").select((-F.col("id")).alias("id"))).distinct()


_FIELDS = ["bpm", "energy", "valence_proxy", "mood_sad", "mood_happy", "danceability_model"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS campo, count(*) FILTER ({c} IS NOT NULL AND NOT isnan({c})) AS presentes, round(count(*) FILTER ({c} IS NOT NULL AND NOT isnan({c})) / count(*), 6) AS parte FROM pista_candidata" for c in _FIELDS))
def audit_coverage(t: Tables) -> DataFrame:
    return A.coverage(t.pista_candidata, _FIELDS)


@query("""SELECT count(*) FILTER (s = 'lista') AS lista, count(*) FILTER (s = 'finalizada') AS finalizada, count(*) FILTER (s = 'descartada') AS descartada, count(*) FILTER (s = 'otra') AS otra
FROM (SELECT CASE WHEN estado IN ('lista', 'finalizada', 'descartada') THEN estado ELSE 'otra' END AS s FROM dj_sesiones)""")
def audit_session_states(t: Tables) -> DataFrame:
    return A.state_counts(t.dj_sesiones, "estado", ["lista", "finalizada", "descartada", "otra"], "otra")


@query("SELECT id, titulo FROM pistas WHERE estado = 'biblioteca' AND duracion_seg > 30 ORDER BY md5(CAST(id AS VARCHAR)), id LIMIT 50")
def pool_audio(t: Tables) -> DataFrame:
    return A.pool(t.pistas, F.col("duracion_seg") > 30)


@query(f"SELECT p.id, p.titulo, greatest(h.ultima, p.ultimo_acceso) AS reciente FROM pistas p JOIN {H} h ON h.pista_id = p.id WHERE p.estado = 'biblioteca' ORDER BY reciente NULLS FIRST, p.id LIMIT 50")
def pool_rediscovery(t: Tables) -> DataFrame:
    return A.rediscovery_pool(t.pistas, t.historial)


@query("SELECT id, titulo FROM pistas WHERE estado = 'biblioteca' AND coalesce(veces_reproducida, 0) <= 2 ORDER BY md5(CAST(id AS VARCHAR)), id LIMIT 50")
def pool_relaxed(t: Tables) -> DataFrame:
    return A.pool(t.pistas, F.coalesce("veces_reproducida", F.lit(0)) <= 2)


@query("""SELECT count(*) FILTER (duracion_seg > 30) AS audio, count(*) FILTER (album_id IS NOT NULL) AS portada, count(*) FILTER (veces_reproducida = 0) AS nunca, count(*) FILTER (veces_reproducida <= 2) AS relajado FROM pistas WHERE estado = 'biblioteca'""")
def pool_counts(t: Tables) -> DataFrame:
    """The size of every pool in one pass."""
    return in_library(t.pistas).agg(F.count_if(F.col("duracion_seg") > 30).alias("audio"), F.count_if(F.col("album_id").isNotNull()).alias("portada"), F.count_if(F.col("veces_reproducida") == 0).alias("nunca"), F.count_if(F.col("veces_reproducida") <= 2).alias("relajado"))


@query("""WITH c AS (SELECT id, titulo FROM pistas WHERE estado = 'biblioteca'), s AS (SELECT DISTINCT pista_id FROM historial WHERE pista_id IS NOT NULL)
SELECT id, titulo FROM c WHERE id NOT IN (SELECT pista_id FROM s) OR NOT EXISTS (SELECT 1 FROM c WHERE id NOT IN (SELECT pista_id FROM s)) ORDER BY md5('11|' || id), id LIMIT 20""")
def pool_round(t: Tables) -> DataFrame:
    """A round of tracks that were not played, or of any if all were."""
    seen = t.historial.select(F.col("pista_id").alias("id")).filter("id is not null")
    return A.sample_round(in_library(t.pistas).select("id", "titulo"), seen, "id", 20, "11")


@query("SELECT id, round(CASE WHEN duracion_seg <= 60 THEN 0.0 ELSE duracion_seg * 0.3 END, 4) AS inicio FROM pistas WHERE duracion_seg IS NOT NULL")
def pool_fragments(t: Tables) -> DataFrame:
    return t.pistas.filter("duracion_seg is not null").select("id", F.round(A.fragment_start(F.col("duracion_seg")), 4).alias("inicio"))


@query("SELECT p.id, p.titulo FROM pistas p JOIN albums a ON a.id = p.album_id WHERE p.estado = 'biblioteca' AND a.mb_release_id IS NOT NULL AND a.mb_release_id <> '' AND p.ruta_archivo <> '' ORDER BY md5(CAST(p.id AS VARCHAR)), p.id LIMIT 50")
def pool_cover(t: Tables) -> DataFrame:
    """Tracks whose album has a cover to show, here a release id."""
    covered = t.albums.filter("mb_release_id is not null and mb_release_id <> ''").select(F.col("id").alias("album_id"))
    return A.pool(t.pistas.join(covered, "album_id", "left_semi"), F.col("ruta_archivo") != "")


_NEVER = "SELECT id, titulo FROM pistas WHERE estado = 'biblioteca' AND coalesce(veces_reproducida, 0) = 0 AND id NOT IN (SELECT pista_id FROM historial WHERE pista_id IS NOT NULL)"


@query(f"""WITH n AS ({_NEVER}), r AS (SELECT id, titulo FROM pistas WHERE estado = 'biblioteca' AND coalesce(veces_reproducida, 0) <= 2) SELECT * FROM (SELECT id, titulo FROM n UNION ALL SELECT id, titulo FROM r WHERE NOT EXISTS (SELECT 1 FROM n)) ORDER BY md5(CAST(id AS VARCHAR)), id LIMIT 50""")
def pool_never(t: Tables) -> DataFrame:
    """Tracks that were never chosen; the relaxed pool if there is none."""
    return A.never_pool(t.pistas, t.historial)


@query("""SELECT p.id, CASE WHEN c.id IS NULL THEN 'faltan' WHEN c.mood_sad IS NULL OR isnan(c.mood_sad) THEN 'sin_profundas' WHEN c.analizado_en < p.actualizado_en THEN 'viejas' ELSE 'otra_version' END AS causa FROM pistas p LEFT JOIN pista_candidata c ON c.id = p.id
WHERE p.estado = 'biblioteca' AND (c.id IS NULL OR c.mood_sad IS NULL OR isnan(c.mood_sad) OR c.analizado_en < p.actualizado_en OR c.titulo <> p.titulo)""")
def audit_feature_versions(t: Tables) -> DataFrame:
    """Tracks whose features are missing, without deep analysis, older than the track, or made from another version of it (here another title)."""
    c = t.pista_candidata.select("id", F.lit(True).alias("_c"), (F.col("mood_sad").isNotNull() & ~F.isnan("mood_sad")).alias("_deep"), "analizado_en", F.col("titulo").alias("_t"))
    j = in_library(t.pistas).select("id", "titulo", "actualizado_en").join(c, "id", "left")
    cause = F.when(F.col("_c").isNull(), "faltan").when(~F.col("_deep"), "sin_profundas").when(F.col("analizado_en") < F.col("actualizado_en"), "viejas").when(F.col("_t") != F.col("titulo"), "otra_version")
    return j.select("id", cause.alias("causa")).filter("causa is not null")


@query("""SELECT p.id, list_filter([CASE WHEN p.album_id IS NULL OR a.mb_release_id IS NULL THEN 'portada' END, CASE WHEN p.isrc IS NULL THEN 'codigo' END, CASE WHEN c.id IS NULL THEN 'rasgos' END, CASE WHEN e.valores IS NULL THEN 'ejes' END], lambda x: x IS NOT NULL) AS faltan FROM pistas p
LEFT JOIN albums a ON a.id = p.album_id LEFT JOIN pista_candidata c ON c.id = p.id LEFT JOIN ejes_pista e ON e.pista_id = p.id WHERE p.estado = 'biblioteca' AND (p.album_id IS NULL OR a.mb_release_id IS NULL OR p.isrc IS NULL OR c.id IS NULL OR e.valores IS NULL)""")
def audit_needed_assets(t: Tables) -> DataFrame:
    """What every track still lacks; tracks that lack nothing are left out."""
    a = t.albums.filter("mb_release_id is not null").select(F.col("id").alias("album_id"), F.lit(True).alias("_cover"))
    c, e = t.pista_candidata.select("id", F.lit(True).alias("_features")), t.ejes_pista.filter("valores is not null").select(F.col("pista_id").alias("id"), F.lit(True).alias("_axes"))
    j = in_library(t.pistas).select("id", "album_id", "isrc").join(a, "album_id", "left").join(c, "id", "left").join(e, "id", "left")
    return A.lacking(j, "id", {"portada": "_cover", "codigo": "isrc", "rasgos": "_features", "ejes": "_axes"})
