"""Rule-made playlists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonalis.materialise import materialise
from tonalis.operators import smartlists as R
from tonalis.operators.listening import as_of
from tonalis.plans.listening import AS_OF, WITH_PLAYS
from tonalis.plans.registry import Registry
from tonalis.tables import Tables

query = Registry()

_C = f"(SELECT *, greatest(ultima, ultimo_acceso) AS reciente FROM {WITH_PLAYS} WHERE estado = 'biblioteca')"


def _c(t: Tables) -> DataFrame:
    return R.candidates(t.pistas, t.historial)


@query(f"SELECT id, titulo FROM {_C} WHERE favorita = 1 AND plays > 0 ORDER BY plays DESC, reciente DESC NULLS LAST, id LIMIT 50")
def smart_favourites(t: Tables) -> DataFrame:
    return R.favourites_playing(_c(t))


@query(f"SELECT id, titulo FROM {_C} WHERE plays > 0 ORDER BY reciente NULLS FIRST, id LIMIT 50")
def smart_rediscover(t: Tables) -> DataFrame:
    return R.rediscover(_c(t))


@query(f"SELECT id, titulo FROM {_C} ORDER BY indexado_en DESC, id LIMIT 50")
def smart_recents(t: Tables) -> DataFrame:
    return R.recents(_c(t))


@query(f"SELECT id, titulo FROM {_C} WHERE plays < 10 ORDER BY plays, indexado_en DESC, id LIMIT 50")
def smart_discover(t: Tables) -> DataFrame:
    return R.to_discover(_c(t))


@query(f"SELECT id, titulo FROM {_C} WHERE plays = 0 ORDER BY indexado_en DESC, id LIMIT 50")
def smart_recent_unplayed(t: Tables) -> DataFrame:
    return R.recent_unplayed(_c(t))


@query(f"SELECT id, titulo FROM {_C} WHERE favorita = 1 AND (reciente IS NULL OR reciente < {AS_OF} - INTERVAL 60 DAY) ORDER BY reciente NULLS FIRST, id LIMIT 50")
def smart_forgotten(t: Tables) -> DataFrame:
    return R.forgotten_favourites(_c(t), as_of(t.historial))


@query(f"SELECT id, titulo FROM {_C} WHERE plays > 0 AND (SELECT sum(plays) FROM {_C}) >= 60 ORDER BY plays DESC, reciente DESC NULLS LAST, id LIMIT 50")
def smart_top(t: Tables) -> DataFrame:
    return R.top_songs(_c(t))


def _frequent(group: str, groups: int, per: int) -> str:
    return f"""WITH c AS (SELECT * FROM {_C} WHERE {group} IS NOT NULL AND plays > 0), g AS (SELECT {group}, row_number() OVER (ORDER BY sum(plays) DESC, {group}) AS puesto_grupo FROM c GROUP BY {group} QUALIFY puesto_grupo <= {groups})
SELECT id, titulo, {group} AS grupo, CAST(puesto_grupo AS INT) AS puesto_grupo, CAST(row_number() OVER (PARTITION BY {group} ORDER BY plays DESC, id) AS INT) AS puesto FROM c JOIN g USING ({group}) QUALIFY puesto <= {per}"""


@query(_frequent("artista_id", 10, 5))
def smart_frequent_artists(t: Tables) -> DataFrame:
    return R.frequent(_c(t), "artista_id", R.ARTISTS, R.PER_ARTIST)


@query(_frequent("album_id", 10, 4))
def smart_frequent_albums(t: Tables) -> DataFrame:
    return R.frequent(_c(t), "album_id", R.ALBUMS, R.PER_ALBUM)


@query(f"""WITH c AS (SELECT * FROM {_C} WHERE album_id IS NOT NULL), g AS (SELECT album_id FROM c GROUP BY 1 HAVING count(*) >= 6 AND (sum(plays) >= 6 OR sum(favorita) >= 2))
SELECT id, titulo, album_id AS grupo, CAST(row_number() OVER (PARTITION BY album_id ORDER BY plays DESC, id) AS INT) AS puesto FROM c WHERE album_id IN (SELECT album_id FROM g) QUALIFY puesto <= 6""")
def smart_return_albums(t: Tables) -> DataFrame:
    return R.albums_to_return(_c(t))


@query(f"""WITH c AS {_C}, o AS (SELECT * FROM c WHERE artista_id <> 1 AND genero IN (SELECT genero FROM c WHERE artista_id = 1 AND genero IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY artista_id ORDER BY plays DESC, id) <= 4)
SELECT id, titulo FROM o ORDER BY plays DESC, id LIMIT 50""")
def smart_similar_artist(t: Tables) -> DataFrame:
    return R.similar_to(_c(t), 1)


def _this_is(artist: int) -> str:
    return f"""WITH c AS {_C}, f AS (SELECT * FROM c WHERE artista_id = {artist} ORDER BY favorita DESC, plays DESC, id LIMIT 320), o AS (SELECT *, row_number() OVER (PARTITION BY album_id ORDER BY favorita DESC, plays DESC, id) AS rn FROM f),
a AS (SELECT id, titulo FROM o ORDER BY rn > 8 AND album_id IS NOT NULL, favorita DESC, plays DESC, id LIMIT 80),
s AS (SELECT * FROM c WHERE artista_id <> {artist} AND genero IN (SELECT genero FROM c WHERE artista_id = {artist} AND genero IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY artista_id ORDER BY plays DESC, id) <= 4),
z AS (SELECT id, titulo, row_number() OVER (ORDER BY plays DESC, id) AS k FROM s)
SELECT id, titulo, true AS propia FROM a UNION ALL SELECT id, titulo, false FROM z WHERE (SELECT count(*) FROM a) < 25 AND k <= 80 - (SELECT count(*) FROM a)"""


@query(_this_is(1))
def smart_this_is(t: Tables) -> DataFrame:
    """An artist with many tracks of their own."""
    return R.this_is(_c(t), 1)


@query(_this_is(5))
def smart_this_is_filled(t: Tables) -> DataFrame:
    """An artist with few tracks, filled up with similar ones."""
    return R.this_is(_c(t), 5)


@query("""SELECT id AS pista_id, row_number() OVER (ORDER BY titulo, id) AS posicion FROM pistas WHERE favorita = 1 AND estado = 'biblioteca'""")
def smart_favourites_mirror(t: Tables) -> DataFrame:
    """All favourites, numbered over pieces rather than in one window."""
    from tonalis.operators.library import in_library, number_rows

    fav = in_library(t.pistas).filter("favorita = 1").select(F.lit(0).alias("g"), F.col("id").alias("pista_id"), "titulo")
    return number_rows(fav, ["g"], [F.asc("titulo"), F.asc("pista_id")]).select("pista_id", "posicion")


@query("""WITH m AS (SELECT album_id, id, coalesce(track_number, 9999) AS n FROM pistas WHERE album_id IS NOT NULL)
SELECT album_id, CAST(sum(CAST('0x' || substr(md5(n || ':' || id), 1, 12) AS BIGINT)) AS VARCHAR) AS firma FROM m GROUP BY 1""")
def smart_signature(t: Tables) -> DataFrame:
    """A digest of the ordered tracks of every album."""
    m = t.pistas.filter("album_id is not null").select("album_id", "id", F.coalesce("track_number", F.lit(9999)).alias("n"))
    return R.signature(m, "album_id", "id", "n")


@query("""SELECT id, CAST(bit_count(xor(id * 2654435761, tamano_bytes)) AS INT) AS distancia FROM pistas""")
def smart_hamming(t: Tables) -> DataFrame:
    """Hamming distance of two 64-bit hashes."""
    return t.pistas.select("id", R.hamming(F.col("id") * F.lit(2654435761), F.col("tamano_bytes")).alias("distancia"))


def _distinct_sql(picks: int = 4) -> str:
    ctes = ["e AS (SELECT label, vec_id, embedding, list_avg(list_transform(embedding, lambda x: x::DOUBLE)) AS m FROM embeddings WHERE label IS NOT NULL)", "l0 AS (SELECT label, vec_id, list_transform(embedding, lambda x: (x::DOUBLE >= m)::INT) AS b FROM e)"]
    for k in range(picks):
        ctes.append(f"p{k} AS (SELECT label, min(vec_id) AS vec_id FROM l{k} GROUP BY label)")
        if k + 1 < picks:
            ctes.append(f"l{k + 1} AS (SELECT l.* FROM l{k} l JOIN p{k} p ON p.label = l.label JOIN l{k} q ON q.label = p.label AND q.vec_id = p.vec_id WHERE list_sum(list_transform(range(1, 65), lambda i: (l.b[i] <> q.b[i])::INT)) > 6)")
    return f"WITH {', '.join(ctes)} " + " UNION ALL ".join(f"SELECT label, CAST({k + 1} AS INT) AS puesto, vec_id FROM p{k}" for k in range(picks))


@query(_distinct_sql())
def smart_distinct_covers(t: Tables) -> DataFrame:
    """Up to four pictures of each label whose perceptual hashes differ by more than six bits; the pictures are the vectors of 64 numbers."""
    h = R.picture_hash(F.transform("embedding", lambda x: x.cast("double")), F.lit(0), F.lit(0), F.lit(0))
    i = t.embeddings.filter("label is not null").select("label", "vec_id", F.col("vec_id").alias("orden"), h["forma"].alias("h"))
    return R.pick_distinct(materialise(i, "hashes"), "label", "vec_id", "orden", "h")


@query(f"""SELECT regla, n, n >= m AS basta FROM (SELECT 'favoritas' AS regla, least(50, count(*) FILTER (favorita = 1 AND plays > 0)) AS n, 12 AS m FROM {_C} UNION ALL SELECT 'nuevas', least(50, count(*) FILTER (plays = 0)), 20 FROM {_C} UNION ALL SELECT 'descubrir', least(50, count(*) FILTER (plays < 10)), 25 FROM {_C})""")
def smart_catalogue(t: Tables) -> DataFrame:
    """The size of several lists and whether each reaches its minimum."""
    c = _c(t)
    return R.catalogue({"favoritas": R.favourites_playing(c), "nuevas": R.recent_unplayed(c), "descubrir": R.to_discover(c)}, {"favoritas": 12, "nuevas": 20, "descubrir": 25})


_MOODS = {"triste": {"sad": 0.9, "slow": 0.6}, "alegre": {"happy": 1.0}, "fiesta": {"party": 1.0, "fast": 0.3}, "concentracion": {"focus": 1.0}, "noche": {"dark": 0.8, "soft": 0.4}, "intensa": {"intense": 1.0}, "entrenar": {"workout": 1.0}}


def _moods_sql() -> str:
    from tonalis.plans.features import _INTENT_SQL

    one = lambda w: " + ".join(f"({v / sum(w.values())}) * ({_INTENT_SQL[k]})" for k, v in w.items())
    parts = " UNION ALL ".join(f"SELECT '{m}' AS animo, id, round(least(1.0, greatest(0.0, {one(w)}))::DOUBLE, 6) AS puntaje FROM pista_candidata" for m, w in _MOODS.items())
    return f"SELECT animo, CAST(row_number() OVER (PARTITION BY animo ORDER BY puntaje DESC, id) AS INT) AS puesto, id, puntaje FROM ({parts}) WHERE puntaje >= 0.35 QUALIFY puesto <= 30"


@query(_moods_sql())
def smart_moods(t: Tables) -> DataFrame:
    """The lists of seven moods."""
    return R.mood_lists(t.pista_candidata, _MOODS)


@query(f"""WITH l AS (SELECT 'favoritas' AS regla, id, row_number() OVER (ORDER BY plays DESC, reciente DESC NULLS LAST, id) AS k FROM {_C} WHERE favorita = 1 AND plays > 0 UNION ALL SELECT 'nuevas', id, row_number() OVER (ORDER BY indexado_en DESC, id) FROM {_C} WHERE plays = 0),
r(regla_id, regla, limite) AS (VALUES (1, 'favoritas', 10), (2, 'nuevas', 50), (3, 'nuevas', 5)) SELECT r.regla_id, l.id FROM r JOIN l ON l.regla = r.regla WHERE l.k <= least(r.limite, 50)""")
def smart_dispatched(t: Tables) -> DataFrame:
    """Lists made by rules written as JSON; a rule without a name and a broken one make none."""
    from pyspark.sql import Window

    c = _c(t)
    number = lambda df, *order: df.withColumn("puesto", F.row_number().over(Window.orderBy(*order, "id"))).select("id", "puesto")
    fav = c.filter("favorita = 1 and plays > 0").orderBy(F.desc("plays"), F.desc_nulls_last("reciente"), "id").limit(R.CAP)
    new = c.filter("plays = 0").orderBy(F.desc("indexado_en"), "id").limit(R.CAP)
    rules = t.spark.createDataFrame([(1, '{"regla": "favoritas", "limite": 10}'), (2, '{"regla": "nuevas"}'), (3, '{"regla": "nuevas", "limite": 5}'), (4, '{"regla": "otra"}'), (5, "{"), (6, None)], "regla_id int, regla_json string")
    return R.dispatched(rules, {"favoritas": number(fav, F.desc("plays"), F.desc_nulls_last("reciente")), "nuevas": number(new, F.desc("indexado_en"))})


@query("""SELECT id, CASE WHEN tipo = 'Single' THEN 'me_gusta' WHEN tipo = 'EP' THEN 'this_is' WHEN lower(tipo) = 'album' AND anio IS NULL THEN 'creada' WHEN anio >= 2000 THEN 'inteligente' WHEN anio < 1970 THEN 'sistema' ELSE 'creada' END AS categoria,
CASE WHEN tipo = 'Single' THEN 'Me gusta' WHEN tipo = 'EP' THEN 'This is...' WHEN anio >= 2000 THEN 'Para ti' WHEN anio < 1970 AND NOT coalesce(lower(tipo) = 'album' AND anio IS NULL, false) THEN 'Sistema' ELSE 'Manual' END AS etiqueta FROM albums""")
def smart_classes(t: Tables) -> DataFrame:
    """Category and label of lists; kind, type and origin are derived from the albums' type and year."""
    kind = F.when(F.col("tipo") == "Single", "favoritos").when(F.col("tipo") == "EP", "this_is").otherwise("otro")
    manual = F.lower("tipo") == "album"
    tipo = F.when(manual & F.col("anio").isNull(), "manual").when(F.col("anio") >= 2000, "automatica").when(F.col("anio") < 1970, "sistema").otherwise("otra")
    c = t.albums.select("id", R.list_class(kind, tipo, F.when(F.col("anio").isNull(), "usuario").otherwise("otro")).alias("c"))
    return c.select("id", "c.categoria", "c.etiqueta")


@query("""WITH e AS (SELECT vec_id, embedding, list_avg(list_transform(embedding, lambda x: x::DOUBLE)) AS m FROM embeddings) SELECT vec_id, CAST(list_sum(list_transform(embedding, lambda x: CASE WHEN x::DOUBLE >= m THEN 1 ELSE 0 END)) AS INT) AS bits, CAST(floor(vec_id % 256 / 16) * 256 + floor(vec_id * 7 % 256 / 16) * 16 + floor(vec_id * 13 % 256 / 16) AS INT) AS color FROM e""")
def smart_picture_hashes(t: Tables) -> DataFrame:
    """The perceptual hash of 8 x 8 pictures, here the vectors of 64 numbers: its set bits, and the mean colour."""
    i = F.col("vec_id")
    h = t.embeddings.select("vec_id", R.picture_hash(F.transform("embedding", lambda x: x.cast("double")), i % 256, i * 7 % 256, i * 13 % 256).alias("h"))
    return h.select("vec_id", F.bit_count("h.forma").alias("bits"), "h.color")
