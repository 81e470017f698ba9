"""Listings of the library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonalis.functions import text as X
from tonalis.operators import library as L
from tonalis.plans.registry import Registry
from tonalis.plans.text import cmp_sql
from tonalis.tables import Tables

query = Registry()

_GROUP = "CASE WHEN lower(trim(tipo)) = 'album' THEN 'albums' WHEN lower(trim(tipo)) IN ('single', 'ep') THEN 'singles_y_ep' ELSE 'otros' END"
_ARTISTS = f"""WITH p AS (SELECT artista_id, count(*) AS pistas, sum(coalesce(duracion_seg, 0)) AS d FROM pistas WHERE estado = 'biblioteca' AND artista_id IS NOT NULL GROUP BY 1),
b AS (SELECT artista_id, count(*) AS albumes, count(*) FILTER ({_GROUP} = 'albums') AS albums, count(*) FILTER ({_GROUP} = 'singles_y_ep') AS singles_y_ep, count(*) FILTER ({_GROUP} = 'otros') AS otros FROM albums GROUP BY 1)
SELECT a.id, a.nombre, coalesce(albumes, 0) AS albumes, coalesce(b.albums, 0) AS albums, coalesce(singles_y_ep, 0) AS singles_y_ep, coalesce(otros, 0) AS otros, pistas, round(d, 2) AS duracion, round(d * greatest(coalesce(albumes, 0), 1), 2) AS duracion_multiplicada
FROM artistas a JOIN p ON p.artista_id = a.id LEFT JOIN b ON b.artista_id = a.id"""
_ALBUMS = f"""WITH x AS (SELECT album_id, count(*) AS pistas, sum(coalesce(duracion_seg, 0)) AS d, CAST(sum(favorita) AS BIGINT) AS favoritas, max(indexado_en) AS ultimo_indexado FROM pistas WHERE estado = 'biblioteca' AND album_id IS NOT NULL GROUP BY 1)
SELECT b.id, b.titulo, b.artista_id, a.nombre AS artista, {_GROUP} AS grupo, b.anio, pistas, round(d, 2) AS duracion, favoritas, ultimo_indexado FROM albums b JOIN artistas a ON a.id = b.artista_id JOIN x ON x.album_id = b.id"""


@query(_ARTISTS)
def artists_list(t: Tables) -> DataFrame:
    return L.artist_listing(t.artistas, t.albums, t.pistas)


@query(_ARTISTS + """ WHERE contains(lower(a.nombre), 'trío') OR EXISTS (SELECT 1 FROM pistas q WHERE q.artista_id = a.id AND q.estado = 'biblioteca'
AND (contains(lower(q.titulo), 'trío') OR contains(lower(q.artista_nombre), 'trío') OR contains(lower(q.album_titulo), 'trío') OR contains(lower(coalesce(q.genero, '')), 'trío')))""")
def artists_list_filtered(t: Tables) -> DataFrame:
    return L.artist_listing(t.artistas, t.albums, t.pistas, text="trío")


@query(f"SELECT {_GROUP} AS grupo, count(DISTINCT b.id) AS albumes FROM albums b JOIN pistas p ON p.album_id = b.id AND p.estado = 'biblioteca' GROUP BY 1")
def album_groups(t: Tables) -> DataFrame:
    live = L.in_library(t.pistas).select("album_id").distinct()
    return t.albums.join(live, F.col("id") == F.col("album_id"), "left_semi").groupBy(L.album_group(F.col("tipo")).alias("grupo")).agg(F.count("*").alias("albumes"))


@query(_ALBUMS)
def albums_list(t: Tables) -> DataFrame:
    return L.album_listing(t.artistas, t.albums, t.pistas)


@query(_ALBUMS + f" WHERE {_GROUP} IN ('singles_y_ep') AND b.anio >= 2000 AND contains(lower(b.titulo), 'ma') ORDER BY anio DESC NULLS LAST, b.id LIMIT 20")
def albums_page(t: Tables) -> DataFrame:
    rules = [L.album_group(F.col("tipo")).isin("singles_y_ep"), F.col("anio") >= 2000, L.contains_text("ma", "titulo")]
    return L.page(L.album_listing(t.artistas, t.albums, t.pistas, rules), [F.desc_nulls_last("anio"), F.asc("id")], 20)


@query("""SELECT b.id, b.titulo, a.nombre AS artista, p.id AS pista_id, p.titulo AS pista, coalesce(p.track_number, 9999) AS orden FROM albums b JOIN artistas a ON a.id = b.artista_id JOIN pistas p ON p.album_id = b.id
WHERE b.id <= 40 AND p.estado = 'biblioteca'""".replace("b.id <= 40 AND ", ""))
def album_tracks(t: Tables) -> DataFrame:
    """The tracks of every album, those without a number last."""
    b = t.albums.join(t.artistas.select(F.col("id").alias("artista_id"), F.col("nombre").alias("artista")), "artista_id").select(F.col("id").alias("album_id"), F.col("titulo").alias("album"), "artista")
    p = L.in_library(t.pistas).select("album_id", F.col("id").alias("pista_id"), F.col("titulo").alias("pista"), F.coalesce("track_number", F.lit(9999)).alias("orden"))
    return p.join(b, "album_id").select(F.col("album_id").alias("id"), F.col("album").alias("titulo"), "artista", "pista_id", "pista", "orden")


@query("""SELECT id, titulo, artista_nombre, anio, duracion_seg FROM pistas WHERE estado = 'biblioteca' AND favorita = 1 AND contains(lower(titulo || ' ' || artista_nombre), 'a')
ORDER BY anio DESC NULLS LAST, lower(titulo), id LIMIT 50 OFFSET 10""")
def tracks_page(t: Tables) -> DataFrame:
    """A page of the favourites that hold a text, newest first, unknown years last."""
    rules = L.all_of([F.col("favorita") == 1, L.contains_text("a", "titulo", "artista_nombre")])
    rows = L.in_library(t.pistas).filter(rules).select("id", "titulo", "artista_nombre", "anio", "duracion_seg")
    return L.page(rows, [F.desc_nulls_last("anio"), F.lower("titulo"), F.asc("id")], 50, 10)


@query("SELECT count(*) AS n FROM pistas WHERE estado = 'biblioteca' AND favorita = 1 AND contains(lower(titulo || ' ' || artista_nombre), 'a')")
def tracks_count(t: Tables) -> DataFrame:
    rules = L.all_of([F.col("favorita") == 1, L.contains_text("a", "titulo", "artista_nombre")])
    return L.in_library(t.pistas).filter(rules).agg(F.count("*").alias("n"))


@query("SELECT id, titulo, ruta_archivo FROM pistas WHERE ruta_archivo = (SELECT min(ruta_archivo) FROM pistas)")
def track_by_path(t: Tables) -> DataFrame:
    """A point lookup by path."""
    first = t.pistas.agg(F.min("ruta_archivo").alias("ruta_archivo"))
    return t.pistas.join(F.broadcast(first), "ruta_archivo", "left_semi").select("id", "titulo", "ruta_archivo")


@query("""SELECT estado, count(*) AS pistas, count(*) FILTER (artista_id IS NULL) AS sin_artista, count(*) FILTER (album_id IS NULL) AS sin_album FROM pistas GROUP BY estado""")
def pending_counts(t: Tables) -> DataFrame:
    """Tracks by state, with those whose parents are missing."""
    return t.pistas.groupBy("estado").agg(F.count("*").alias("pistas"), F.count_if(F.col("artista_id").isNull()).alias("sin_artista"), F.count_if(F.col("album_id").isNull()).alias("sin_album"))


@query("SELECT id, titulo, estado, indexado_en FROM pistas WHERE estado IN ('revision', 'cuarentena') AND (isrc IS NULL OR mb_recording_id IS NULL)")
def pending_tracks(t: Tables) -> DataFrame:
    return t.pistas.filter(F.col("estado").isin("revision", "cuarentena") & (F.col("isrc").isNull() | F.col("mb_recording_id").isNull())).select("id", "titulo", "estado", "indexado_en")


@query(f"""WITH f AS (SELECT id, nombre, {cmp_sql('nombre')} AS k FROM artistas) SELECT id, nombre, CASE WHEN trim(nombre) = '' THEN '3' WHEN regexp_matches(k, '^[0-9]') THEN '0' WHEN regexp_matches(k, '^[a-z]') THEN '1' ELSE '2' END || k AS clave FROM f""")
def artist_sort_keys(t: Tables) -> DataFrame:
    """Digits before Latin letters before other scripts before blanks."""
    return t.artistas.select("id", "nombre", L.sort_key(F.col("nombre"), X.compare_form(F.col("nombre"))).alias("clave"))


@query("""SELECT lower(nombre) AS nombre, count(*) AS veces FROM artistas GROUP BY lower(nombre) HAVING count(*) > 1""")
def repeated_names(t: Tables) -> DataFrame:
    return t.artistas.groupBy(F.lower("nombre").alias("nombre")).agg(F.count("*").alias("veces")).filter("veces > 1")


@query(r"""SELECT regexp_replace(titulo, '\s*\(.*$', '') AS base, CAST(coalesce(max(try_cast(nullif(regexp_extract(titulo_slug, '_([0-9]+)$', 1), '') AS INT)), 0) + 1 AS INT) AS siguiente FROM albums GROUP BY 1""")
def next_volume(t: Tables) -> DataFrame:
    """The next free number of each album title: the largest numeric suffix of its slugs plus one."""
    n = F.nullif(F.regexp_extract("titulo_slug", "_([0-9]+)$", 1), F.lit("")).try_cast("int")
    return t.albums.groupBy(F.regexp_replace("titulo", r"\s*\(.*$", "").alias("base")).agg((F.coalesce(F.max(n), F.lit(0)) + 1).alias("siguiente"))


@query("""SELECT (SELECT count(*) FROM pistas WHERE estado = 'biblioteca') AS pistas, (SELECT count(DISTINCT artista_id) FROM pistas WHERE estado = 'biblioteca') AS artistas,
(SELECT count(DISTINCT album_id) FROM pistas WHERE estado = 'biblioteca') AS albumes, (SELECT round(sum(coalesce(duracion_seg, 0)), 1) FROM pistas WHERE estado = 'biblioteca') AS duracion,
(SELECT CAST(sum(favorita) AS BIGINT) FROM pistas WHERE estado = 'biblioteca') AS favoritas, (SELECT count(*) FROM historial) AS reproducciones""")
def library_totals(t: Tables) -> DataFrame:
    """The totals of the library in one pass over each table."""
    p = L.in_library(t.pistas).agg(F.count("*").alias("pistas"), F.countDistinct("artista_id").alias("artistas"), F.countDistinct("album_id").alias("albumes"), F.round(F.sum(F.coalesce("duracion_seg", F.lit(0.0))), 1).alias("duracion"), F.sum("favorita").alias("favoritas"))
    return p.withColumn("reproducciones", t.historial.agg(F.count("*")).scalar())


@query("""SELECT id, titulo, artista_nombre, indexado_en FROM pistas WHERE estado = 'biblioteca' ORDER BY indexado_en DESC, id DESC LIMIT 12""")
def recent_tracks(t: Tables) -> DataFrame:
    return L.in_library(t.pistas).select("id", "titulo", "artista_nombre", "indexado_en").orderBy(F.desc("indexado_en"), F.desc("id")).limit(12)


@query(f"SELECT * FROM ({_ALBUMS}) ORDER BY ultimo_indexado DESC, id LIMIT 12")
def recent_albums(t: Tables) -> DataFrame:
    return L.album_listing(t.artistas, t.albums, t.pistas).orderBy(F.desc("ultimo_indexado"), "id").limit(12)


@query("""SELECT a.id, a.nombre, max(p.indexado_en) AS ultimo, arg_max(p.ruta_archivo, (p.indexado_en, p.id)) AS portada FROM artistas a JOIN pistas p ON p.artista_id = a.id AND p.estado = 'biblioteca' GROUP BY a.id, a.nombre ORDER BY ultimo DESC, a.id LIMIT 12""")
def recent_artists(t: Tables) -> DataFrame:
    """Artists by their newest track, with the path of that track."""
    per = L.in_library(t.pistas).filter("artista_id is not null").groupBy("artista_id").agg(F.max("indexado_en").alias("ultimo"), F.max_by("ruta_archivo", F.struct("indexado_en", "id")).alias("portada"))
    return t.artistas.join(per, F.col("id") == F.col("artista_id")).select("id", "nombre", "ultimo", "portada").orderBy(F.desc("ultimo"), "id").limit(12)


@query("""WITH b AS (SELECT album_id AS id, count(*) AS pistas, round(sum(coalesce(duracion_seg, 0)), 2) AS duracion, arg_min(titulo, (coalesce(track_number, 9999), id)) AS primera FROM pistas WHERE estado = 'biblioteca' AND album_id IS NOT NULL GROUP BY 1)
SELECT a.id, a.titulo, r.nombre AS artista, a.anio, b.pistas, b.duracion, b.primera FROM albums a JOIN artistas r ON r.id = a.artista_id JOIN b ON b.id = a.id""")
def album_detail(t: Tables) -> DataFrame:
    """Every album with its artist, its size and its first track."""
    p = L.in_library(t.pistas).filter("album_id is not null").groupBy(F.col("album_id").alias("id")).agg(F.count("*").alias("pistas"), F.round(F.sum(F.coalesce("duracion_seg", F.lit(0.0))), 2).alias("duracion"), F.min_by("titulo", F.struct(F.coalesce("track_number", F.lit(9999)), "id")).alias("primera"))
    r = t.artistas.select(F.col("id").alias("artista_id"), F.col("nombre").alias("artista"))
    return t.albums.join(r, "artista_id").join(p, "id").select("id", "titulo", "artista", "anio", "pistas", "duracion", "primera")


@query("""SELECT artista_id, id, titulo, CAST(row_number() OVER (PARTITION BY artista_id ORDER BY veces_reproducida DESC, id) AS INT) AS puesto FROM pistas WHERE estado = 'biblioteca' AND artista_id IS NOT NULL QUALIFY puesto <= 10""")
def artist_top(t: Tables) -> DataFrame:
    """The ten most played tracks of every artist."""
    from tonalis.operators.listening import top_by_group

    p = L.in_library(t.pistas).filter("artista_id is not null").select("artista_id", "id", "titulo", "veces_reproducida")
    return top_by_group(p, "artista_id", [F.desc("veces_reproducida"), F.asc("id")], 10, "puesto").select("artista_id", "id", "titulo", "puesto")


@query(r"""WITH d AS (SELECT DISTINCT titulo FROM albums), n AS (SELECT regexp_extract(titulo, '^(.*) ([1-9][0-9]*)$', 1) AS stem, TRY_CAST(regexp_extract(titulo, '^(.*) ([1-9][0-9]*)$', 2) AS BIGINT) AS k FROM d),
s AS (SELECT d.titulo, n.k, row_number() OVER (PARTITION BY d.titulo ORDER BY n.k) + 1 AS expect FROM d JOIN n ON n.stem = d.titulo WHERE n.k >= 2), g AS (SELECT titulo, min(CASE WHEN k <> expect THEN expect END) AS hole, max(k) + 1 AS nxt FROM s GROUP BY 1)
SELECT d.titulo, d.titulo || ' ' || coalesce(g.hole, g.nxt, 2) AS libre FROM d LEFT JOIN g USING (titulo)""")
def unique_names(t: Tables) -> DataFrame:
    """A free name for a copy of every album."""
    names = t.albums.select(F.col("titulo").alias("nombre")).distinct()
    return L.free_names(names, names).select(F.col("nombre").alias("titulo"), "libre")


@query("""WITH u AS (SELECT pista_id, arg_max(titulo_snap, (reproducido_en, id)) AS titulo_visto, max(reproducido_en) AS ultima FROM (SELECT DISTINCT id, pista_id, titulo_snap, reproducido_en FROM historial) WHERE pista_id IS NOT NULL GROUP BY 1),
v AS (SELECT pista_id, arg_max(sesion_id, (registrado_en, sesion_id)) AS ultima_sesion FROM score_detalle GROUP BY 1) SELECT p.id, p.titulo, u.ultima, v.ultima_sesion FROM pistas p LEFT JOIN u ON u.pista_id = p.id LEFT JOIN v ON v.pista_id = p.id WHERE p.estado = 'biblioteca' ORDER BY u.ultima DESC NULLS LAST, p.id LIMIT 100""")
def tracks_latest(t: Tables) -> DataFrame:
    """A page of tracks, each with its latest play and the last session that scored it: one aggregate a table instead of a subquery a row."""
    u = t.historial.filter("pista_id is not null").groupBy(F.col("pista_id").alias("id")).agg(F.max("reproducido_en").alias("ultima"))
    v = t.score_detalle.groupBy(F.col("pista_id").alias("id")).agg(F.max_by("sesion_id", F.struct("registrado_en", "sesion_id")).alias("ultima_sesion"))
    return L.in_library(t.pistas).select("id", "titulo").join(u, "id", "left").join(v, "id", "left").orderBy(F.desc_nulls_last("ultima"), "id").limit(100)


@query("""WITH c AS (SELECT CAST(id AS VARCHAR) AS clave, energy FROM pista_candidata) SELECT p.id, c.energy FROM pistas p JOIN c ON c.clave = CAST(p.id AS VARCHAR) WHERE c.energy IS NOT NULL AND NOT isnan(c.energy)""")
def tracks_by_text_id(t: Tables) -> DataFrame:
    """A join of numbers with ids kept as text: the text is cast once, so the join is on numbers; what is no number joins nothing."""
    c = t.pista_candidata.select(F.col("id").cast("string").alias("clave"), "energy").filter("energy is not null and not isnan(energy)")
    return t.pistas.select("id").join(c.select(F.col("clave").try_cast("bigint").alias("id"), "energy"), "id")


@query("""SELECT artista_id, arg_max(doc_id, (creado_en, doc_id)) AS doc_id, max(creado_en) AS creado_en, count(*) AS n FROM documents WHERE artista_id IS NOT NULL AND tipo = 'biografia' GROUP BY 1""")
def latest_biography(t: Tables) -> DataFrame:
    """The latest document of a kind for each entity."""
    d = t.documents.filter("artista_id is not null and tipo = 'biografia'")
    return d.groupBy("artista_id").agg(F.max_by("doc_id", F.struct("creado_en", "doc_id")).alias("doc_id"), F.max("creado_en").alias("creado_en"), F.count("*").alias("n"))


_KEY = lambda c: f"CASE WHEN {c} IS NULL OR trim({c}) = '' THEN '3' WHEN regexp_matches({cmp_sql(c)}, '^[0-9]') THEN '0' WHEN regexp_matches({cmp_sql(c)}, '^[a-z]') THEN '1' ELSE '2' END || coalesce({cmp_sql(c)}, '')"
_ORDERS = {
    "titulo": "kt, ka", "titulo_desc": "kt DESC, ka", "artista": "ka, kb, n", "artista_desc": "ka DESC, kb, n", "album": "kb, n, kt", "album_desc": "kb DESC, n, kt", "anio": "coalesce(anio, 0) DESC, kt", "anio_asc": "coalesce(anio, 0), kt",
    "duracion": "coalesce(duracion_seg, 0) DESC, kt", "duracion_asc": "coalesce(duracion_seg, 0), kt", "reproducida": "coalesce(veces_reproducida, 0) DESC, kt", "reproducida_asc": "coalesce(veces_reproducida, 0), kt",
    "reciente": "ultimo_acceso DESC NULLS LAST, actualizado_en DESC NULLS LAST", "reciente_asc": "ultimo_acceso NULLS FIRST, actualizado_en NULLS FIRST",
}


@query(f"WITH k AS (SELECT *, {_KEY('titulo')} AS kt, {_KEY('artista_nombre')} AS ka, {_KEY('album_titulo')} AS kb, coalesce(track_number, 9999) AS n FROM pistas WHERE estado = 'biblioteca') " + " UNION ALL ".join(f"(SELECT '{o}' AS orden, id FROM k ORDER BY {s}, id LIMIT 6 OFFSET 2)" for o, s in _ORDERS.items()))
def tracks_orders(t: Tables) -> DataFrame:
    """A page of the library in each of its fourteen orders."""
    key = lambda c: L.sort_key(F.col(c), X.compare_form(F.col(c)))
    out = None
    for o in _ORDERS:
        one = L.track_page(t.pistas, o, key, 6, 2).select(F.lit(o).alias("orden"), "id")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT id, titulo, CASE WHEN isrc IS NULL THEN 'sin_codigo' WHEN mb_recording_id IS NULL THEN 'sin_identidad' ELSE 'otra' END AS causa, CAST(indexado_en AS DATE) AS sesion FROM pistas WHERE estado IN ('revision', 'cuarentena')
AND CASE WHEN isrc IS NULL THEN 'sin_codigo' WHEN mb_recording_id IS NULL THEN 'sin_identidad' ELSE 'otra' END = 'sin_codigo' AND contains(lower(titulo || ' ' || artista_nombre), 'a') AND CAST(indexado_en AS DATE) >= DATE '2020-01-01'""")
def pending_filtered(t: Tables) -> DataFrame:
    """Pending tracks of one cause, from a session on, that hold a text."""
    cause = F.when(F.col("isrc").isNull(), "sin_codigo").when(F.col("mb_recording_id").isNull(), "sin_identidad").otherwise("otra")
    rows = t.pistas.filter(F.col("estado").isin("revision", "cuarentena")).withColumns({"causa": cause, "sesion": F.to_date("indexado_en")})
    rules = [F.col("causa") == "sin_codigo", L.contains_text("a", "titulo", "artista_nombre"), F.col("sesion") >= F.lit("2020-01-01").cast("date")]
    return rows.filter(L.all_of(rules)).select("id", "titulo", "causa", "sesion")


_ALBUM_ORDERS = {
    "artista": "ka, coalesce(anio, 0), kt", "artista_desc": "ka DESC, coalesce(anio, 0) DESC, kt", "titulo": "kt", "titulo_desc": "kt DESC", "anio": "coalesce(anio, 0) DESC, kt", "anio_asc": "coalesce(anio, 0), kt",
    "duracion": "duracion DESC, kt", "duracion_asc": "duracion, kt", "pistas": "pistas DESC, kt", "pistas_asc": "pistas, kt",
}
_ARTIST_ORDERS = {"nombre": "kt", "nombre_desc": "kt DESC", "num_pistas": "pistas DESC, kt", "num_pistas_asc": "pistas, kt", "num_albums": "albumes DESC, kt", "num_albums_asc": "albumes, kt", "duracion": "duracion DESC, kt", "duracion_asc": "duracion, kt"}


@query(f"WITH l AS (SELECT * FROM ({_ALBUMS})), k AS (SELECT *, {_KEY('titulo')} AS kt, {_KEY('artista')} AS ka FROM l) " + " UNION ALL ".join(f"(SELECT '{o}' AS orden, id FROM k ORDER BY {s}, id LIMIT 6)" for o, s in _ALBUM_ORDERS.items()))
def albums_orders(t: Tables) -> DataFrame:
    """A page of the albums in each of their ten orders."""
    key = lambda c: L.sort_key(F.col(c), X.compare_form(F.col(c)))
    year = F.coalesce("anio", F.lit(0))
    extra = {"artista": [key("artista").asc(), year.asc(), key("titulo").asc()], "artista_desc": [key("artista").desc(), year.desc(), key("titulo").asc()]}
    rows, out = L.album_listing(t.artistas, t.albums, t.pistas), None
    for o in _ALBUM_ORDERS:
        one = L.page(rows, L.listing_order(o, key, {"titulo": "titulo", "anio": "anio", "duracion": "duracion", "pistas": "pistas"}, extra), 6).select(F.lit(o).alias("orden"), "id")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH l AS (SELECT * FROM ({_ARTISTS})), k AS (SELECT *, {_KEY('nombre')} AS kt FROM l) " + " UNION ALL ".join(f"(SELECT '{o}' AS orden, id FROM k ORDER BY {s}, id LIMIT 6)" for o, s in _ARTIST_ORDERS.items()))
def artists_orders(t: Tables) -> DataFrame:
    """A page of the artists in each of their eight orders."""
    key = lambda c: L.sort_key(F.col(c), X.compare_form(F.col(c)))
    rows, out = L.artist_listing(t.artistas, t.albums, t.pistas), None
    for o in _ARTIST_ORDERS:
        one = L.page(rows, L.listing_order(o, key, {"nombre": "nombre", "num_pistas": "pistas", "num_albums": "albumes", "duracion": "duracion"}), 6).select(F.lit(o).alias("orden"), "id")
        out = one if out is None else out.unionByName(one)
    return out
