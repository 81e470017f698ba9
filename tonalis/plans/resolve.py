"""Records matched with candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonalis.operators import resolve as E
from tonalis.plans.registry import Registry
from tonalis.plans.text import VARIANT_SQL, cmp_sql, jaccard_sql, tokens_sql
from tonalis.functions.text import VERSION_WORDS
from tonalis.tables import Tables

query = Registry()

_V = "|".join(sorted(VERSION_WORDS, key=len, reverse=True))


def strip_sql(x: str) -> str:
    return rf"coalesce(nullif(trim(regexp_replace({x}, '\s*[\(\[]\s*(?:{_V})[^\)\]]*[\)\]]', '', 'gi')), ''), {x})"


_CODE = r"CASE WHEN regexp_matches(upper(regexp_replace(isrc, '[\s\-]', '', 'g')), '^[A-Z]{2}[A-Z0-9]{3}[0-9]{7}$') THEN upper(regexp_replace(isrc, '[\s\-]', '', 'g')) END"
_PAIRS = f"""WITH r AS (SELECT p.id, titulo, artista_nombre, album_titulo, duracion_seg, track_number, p.anio, {_CODE} AS isrc, mb_recording_id, b.tipo FROM pistas p LEFT JOIN (SELECT id, tipo FROM albums) b ON b.id = p.album_id),
k AS (SELECT *, 'i:' || isrc AS block FROM r WHERE isrc IS NOT NULL UNION ALL SELECT *, 't:' || {cmp_sql(strip_sql('titulo'))} || '|' || {cmp_sql('artista_nombre')} FROM r),
q AS (SELECT DISTINCT a.id, b.id AS c_id FROM k a JOIN k b ON a.block = b.block WHERE a.id <> b.id),
t AS (SELECT *, {tokens_sql(strip_sql('titulo'))} AS tt, {tokens_sql('titulo')} AS tf, {tokens_sql('artista_nombre')} AS ta, {tokens_sql(strip_sql('album_titulo'))} AS tb, {cmp_sql("coalesce(album_titulo, '')")} AS fb, lower({VARIANT_SQL}) AS lv, lower(trim(tipo)) AS lt FROM r),
s AS (SELECT q.id, q.c_id, CASE WHEN {jaccard_sql('a.tt', 'b.tt')} < 0.7 THEN greatest({jaccard_sql('a.tt', 'b.tt')}, {jaccard_sql('a.tf', 'b.tf')} * 0.95) ELSE {jaccard_sql('a.tt', 'b.tt')} END AS s_titulo, {jaccard_sql('a.ta', 'b.ta')} AS s_artista, CASE WHEN a.fb = '' THEN 0.5 WHEN b.fb = '' THEN 0.2 ELSE {jaccard_sql('a.tb', 'b.tb')} END AS s_album, abs(a.duracion_seg - b.duracion_seg) AS d, a.track_number - b.track_number AS n,
 CASE WHEN b.lt IN ('album', 'single', 'ep') THEN 1.0 WHEN b.lt IN ('compilation', 'live', 'remix', 'dj-mix') THEN CASE WHEN a.lv = b.lt THEN 0.65 ELSE 0.2 END WHEN coalesce(b.lt, '') = '' THEN 0.4 ELSE 0.5 END AS s_tipo,
 CASE WHEN b.lt = 'compilation' THEN 0.25 WHEN b.lt IN ('live', 'remix', 'dj-mix') THEN CASE WHEN a.lv = b.lt THEN 0.20 * 0.30 ELSE 0.20 END ELSE 0.0 END AS pena,
 CASE WHEN a.isrc IS NOT NULL AND b.isrc IS NOT NULL THEN CASE WHEN a.isrc = b.isrc THEN 1.0 ELSE 0.1 END WHEN a.isrc IS NOT NULL THEN 0.4 ELSE 0.5 END AS s_isrc,
 coalesce(CASE WHEN a.anio = b.anio THEN 0.04 WHEN abs(a.anio - b.anio) <= 1 THEN 0.02 END, 0) + coalesce(CASE WHEN a.isrc = b.isrc THEN 0.22 END, 0) AS extra,
 (a.isrc = b.isrc) AS same_code, (a.mb_recording_id = b.mb_recording_id) AS same_id FROM q JOIN t a ON a.id = q.id JOIN t b ON b.id = q.c_id),
f AS (SELECT *, CAST(coalesce(CASE WHEN d <= 3 THEN 1.0 WHEN d <= 10 THEN round_even(1.0 - 0.5 * ((d - 3) / 7), 4) WHEN d <= 30 THEN round_even(greatest(0.05, 0.5 - 0.45 * ((d - 10) / 20)), 4) WHEN d IS NOT NULL THEN 0.0 END, 0.5) AS DOUBLE) AS s_duracion,
 CAST(coalesce(CASE WHEN n = 0 THEN 1.0 WHEN abs(n) = 1 THEN 0.4 WHEN n IS NOT NULL THEN 0.0 END, 0.5) AS DOUBLE) AS s_numero FROM s),
p AS (SELECT *, round(CAST(least(1.0, greatest(0.0, s_titulo * 0.28 + s_artista * 0.23 + s_duracion * 0.18 + s_album * 0.10 + s_numero * 0.07 + s_tipo * 0.07 + s_isrc * 0.07 + extra - pena)) AS DOUBLE), 6) AS puntaje FROM f)
"""


def _records(t: Tables) -> DataFrame:
    p = t.pistas.select("id", "titulo", "artista_nombre", "album_titulo", "duracion_seg", "track_number", "anio", E.code("isrc").alias("isrc"), "mb_recording_id", "album_id")
    return p.join(t.albums.select(F.col("id").alias("album_id"), "tipo"), "album_id", "left").drop("album_id")


def _pairs(t: Tables, exact: bool) -> DataFrame:
    r = E.prepared(_records(t), exact)
    return E.scored(E.block_pairs(r, r), exact)


@query(_PAIRS + "SELECT id, c_id, round(s_duracion, 6) AS s_duracion, round(s_numero, 6) AS s_track_number, CAST(s_tipo AS DOUBLE) AS s_tipo_release, CAST(s_isrc AS DOUBLE) AS s_isrc, round(s_titulo, 6) AS s_titulo, round(s_artista, 6) AS s_artista, round(s_album, 6) AS s_album FROM p")
def match_criteria(t: Tables) -> DataFrame:
    """The criteria of every blocked pair, with shared words for the similarity of texts."""
    names = ("duracion", "track_number", "tipo_release", "isrc", "titulo", "artista", "album")
    return _pairs(t, True).select("id", "c_id", *[F.round(f"s_{n}", 6).alias(f"s_{n}") for n in names])


@query(_PAIRS + "SELECT id, c_id, puntaje FROM p")
def match_score(t: Tables) -> DataFrame:
    return _pairs(t, True).select("id", "c_id", "puntaje")


@query(_PAIRS + """, w AS (SELECT id, c_id, puntaje, row_number() OVER (PARTITION BY id ORDER BY puntaje DESC, c_id) AS n FROM p), b AS (SELECT id, max(c_id) FILTER (n = 1) AS candidato, max(puntaje) AS pm, max(puntaje) - CASE WHEN count(*) > 1 THEN min(puntaje) ELSE 0.0 END AS brecha, count(*) AS many FROM w WHERE n <= 2 GROUP BY id),
c AS (SELECT id, candidato, round(CASE WHEN many > 1 AND brecha < 0.1 THEN greatest(CASE WHEN pm >= 0.55 THEN 0.55 ELSE 0.0 END, pm - 0.15) ELSE pm END, 6) AS puntaje, round(brecha, 6) AS brecha FROM b)
SELECT *, CASE WHEN puntaje >= 0.82 THEN 'aceptado' WHEN puntaje >= 0.55 THEN 'revision' ELSE 'cuarentena' END AS ruta FROM c""")
def match_route(t: Tables) -> DataFrame:
    """The best candidate of every record and its route."""
    return E.decided(_pairs(t, True))


@query(_PAIRS + f""", w AS (SELECT p.*, row_number() OVER (PARTITION BY p.id ORDER BY p.puntaje DESC, p.c_id) AS lugar, lead(p.puntaje) OVER (PARTITION BY p.id ORDER BY p.puntaje DESC, p.c_id) AS segundo FROM p),
b AS (SELECT w.*, segundo IS NOT NULL AND puntaje - segundo < 0.1 AS ambigua, CASE WHEN segundo IS NOT NULL AND puntaje - segundo < 0.1 THEN greatest(CASE WHEN puntaje >= 0.55 THEN 0.55 ELSE 0.0 END, puntaje - 0.15) ELSE puntaje END AS final, c.tipo AS ctipo, {VARIANT_SQL} AS variante
 FROM w JOIN r ON r.id = w.id LEFT JOIN (SELECT id AS c_id, tipo FROM r) c ON c.c_id = w.c_id WHERE lugar = 1),
d AS (SELECT *, CASE WHEN round(final, 6) >= 0.82 THEN 'aceptado' WHEN round(final, 6) >= 0.55 THEN 'revision' ELSE 'cuarentena' END AS ruta FROM b)
SELECT id, ruta, CASE WHEN ruta = 'revision' THEN CASE WHEN ambigua AND final < puntaje THEN 'candidatos_ambiguos' WHEN NOT coalesce(ctipo IN ('Album', 'Single', 'EP'), false) AND variante IS NULL THEN 'tipo_dudoso' WHEN s_duracion < 0.3 THEN 'duracion_marginal' ELSE 'puntaje_intermedio' END
 WHEN s_titulo < 0.3 THEN 'metadata_insuficiente' ELSE 'puntaje_bajo' END AS causa FROM d WHERE ruta <> 'aceptado'""")
def match_causes(t: Tables) -> DataFrame:
    """Why a record is left for review or in quarantine."""
    return E.causes(_pairs(t, True))


@query()
def match_score_full(t: Tables) -> DataFrame:
    """The same pairs with the full similarity of texts (sequence ratio in Arrow batches)."""
    return E.full_scores(_records(t))


@query(_PAIRS + """SELECT id, c_id, round_even(CAST(s_titulo * 0.28 + s_artista * 0.26 + coalesce(CASE WHEN d <= 2 THEN 1.0 WHEN d <= 5 THEN 0.8 WHEN d <= 12 THEN 0.6 WHEN d IS NOT NULL THEN 0.2 END, 0.5) * 0.18 + coalesce(same_code::INT, 0) * 0.18 + coalesce(same_id::INT, 0) * 0.10 AS DOUBLE), 4) AS evidencia FROM p""")
def match_second_evidence(t: Tables) -> DataFrame:
    df = _pairs(t, True)
    return df.select("id", "c_id", E.second_evidence(df).alias("evidencia"))


@query(f"""WITH k AS (SELECT id, 1 AS rango, 'h:' || hash_sha256 AS clave FROM pistas WHERE hash_sha256 IS NOT NULL UNION ALL SELECT id, 2, 'i:' || {_CODE} FROM pistas WHERE {_CODE} IS NOT NULL UNION ALL SELECT id, 3, 't:' || {cmp_sql('artista_nombre')} || '|' || {cmp_sql('titulo')} FROM pistas),
r AS (SELECT clave, CAST(min(id) AS VARCHAR) AS valor FROM k GROUP BY clave) SELECT k.id, arg_min(r.valor, (k.rango, k.clave)) AS valor, CAST(min(k.rango) AS INT) AS rango FROM k JOIN r USING (clave) GROUP BY k.id""")
def override_precedence(t: Tables) -> DataFrame:
    """A lookup by hash, else code, else artist and title; here each key's rule is its first holder."""
    from tonalis.functions.text import compare_form

    p = t.pistas
    e = F.array_compact(F.array(F.when(F.col("hash_sha256").isNotNull(), F.struct(F.lit(1).alias("rango"), F.concat(F.lit("h:"), "hash_sha256").alias("clave"))), F.when(E.code("isrc").isNotNull(), F.struct(F.lit(2).alias("rango"), F.concat(F.lit("i:"), E.code("isrc")).alias("clave"))), F.struct(F.lit(3).alias("rango"), F.concat(F.lit("t:"), compare_form(F.col("artista_nombre")), F.lit("|"), compare_form(F.col("titulo"))).alias("clave"))))
    keys = p.select("id", F.explode(e).alias("k")).select("id", "k.rango", "k.clave")
    rules = keys.groupBy("clave").agg(F.min("id").cast("string").alias("valor"))
    return E.first_rule(keys, rules)


@query(_PAIRS + """SELECT p.id, p.c_id, (s_titulo >= 0.75 AND s_artista >= 0.65 AND (r.isrc IS NOT NULL OR r.mb_recording_id IS NOT NULL OR (s_titulo >= 0.90 AND s_artista >= 0.85))) AS solida,
list_filter([CASE WHEN same_code THEN 'isrc' END, CASE WHEN same_id THEN 'mb' END, CASE WHEN s_titulo >= 0.75 THEN 'titulo' END, CASE WHEN s_artista >= 0.70 THEN 'artista' END], lambda x: x IS NOT NULL) AS fuentes,
CAST(CASE WHEN s_titulo >= 0.75 AND s_artista >= 0.70 THEN 0.06 WHEN s_titulo >= 0.75 OR s_artista >= 0.70 THEN 0.03 ELSE 0 END AS DOUBLE) AS bono FROM p JOIN r ON r.id = p.id""")
def match_identity(t: Tables) -> DataFrame:
    """Whether a pair is one identity, the evidence it has, and the bonus for agreement."""
    return _pairs(t, True).select("id", "c_id", E.solid_identity().alias("solida"), E.sources_used().alias("fuentes"), E.agreement_bonus(F.col("s_titulo"), F.col("s_artista")).alias("bono"))


@query(_PAIRS + """, h AS (SELECT id, c_id, coalesce(s_isrc = 1.0, false) AS hit FROM p), g AS (SELECT id, bool_or(hit) AS alguno FROM h GROUP BY id) SELECT h.id, h.c_id FROM h JOIN g USING (id) WHERE hit OR NOT alguno""")
def match_filter_or_all(t: Tables) -> DataFrame:
    """The candidates with the record's code, or all where none has it."""
    return E.filter_or_all(_pairs(t, True), F.col("s_isrc") == 1.0).select("id", "c_id")


@query(_PAIRS + """, e AS (SELECT id, c_id, round_even(CAST(s_titulo * 0.28 + s_artista * 0.26 + coalesce(CASE WHEN d <= 2 THEN 1.0 WHEN d <= 5 THEN 0.8 WHEN d <= 12 THEN 0.6 WHEN d IS NOT NULL THEN 0.2 END, 0.5) * 0.18 + coalesce(same_code::INT, 0) * 0.18 + coalesce(same_id::INT, 0) * 0.10 AS DOUBLE), 4) AS evidencia, coalesce(same_code, false) OR coalesce(same_id, false) AS fuerte FROM p),
w AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY evidencia DESC, c_id) AS n FROM e), b AS (SELECT id, max(c_id) FILTER (n = 1) AS c_id, bool_or(fuerte) FILTER (n = 1) AS fuerte, max(evidencia) AS evidencia, round(max(evidencia) - CASE WHEN count(*) > 1 THEN min(evidencia) ELSE 0.0 END, 6) AS brecha FROM w WHERE n <= 2 GROUP BY id)
SELECT id, c_id, evidencia, brecha FROM b WHERE evidencia >= 0.86 AND brecha >= 0.12 AND fuerte""")
def match_promoted(t: Tables) -> DataFrame:
    """Records whose best candidate wins on a second look."""
    df = _pairs(t, True)
    strong = F.coalesce(F.col("isrc") == F.col("c_isrc"), F.lit(False)) | F.coalesce(F.col("mb_recording_id") == F.col("c_mb_recording_id"), F.lit(False))
    return E.promoted(df.select("id", "c_id", E.second_evidence(df).alias("evidencia"), strong.alias("fuerte")))


@query(f"""WITH x AS (SELECT p.id, lower(trim(coalesce(b.tipo, ''))) AS k, coalesce(p.album_titulo, '') AS album, {tokens_sql(strip_sql('p.titulo'))} AS a, {tokens_sql(strip_sql('p.album_titulo'))} AS c FROM pistas p LEFT JOIN albums b ON b.id = p.album_id)
SELECT id, CASE WHEN k = 'album' THEN 'albumes' WHEN k IN ('single', 'ep') THEN 'singles_y_ep' WHEN k <> '' THEN 'otros' WHEN album = '' THEN 'otros' WHEN {jaccard_sql('a', 'c')} >= 0.75 THEN 'singles_y_ep' ELSE 'albumes' END AS carpeta FROM x""")
def match_folders(t: Tables) -> DataFrame:
    """The folder of every track's release."""
    j = t.pistas.join(t.albums.select(F.col("id").alias("album_id"), "tipo"), "album_id", "left")
    return j.select("id", E.folder_of(F.col("tipo"), F.col("titulo"), F.col("album_titulo"), True).alias("carpeta"))


_TAGS = f"""WITH j AS (SELECT p.id, p.titulo, p.artista_nombre, p.isrc, c.titulo AS x_titulo, c.artista_nombre AS x_artista, {{huella}} AS huella, {cmp_sql("coalesce(p.titulo, '')")} AS t, {cmp_sql("coalesce(p.artista_nombre, '')")} AS a, {cmp_sql("coalesce(c.titulo, '')")} AS xt, {cmp_sql("coalesce(c.artista_nombre, '')")} AS xa FROM pistas p LEFT JOIN pista_candidata c ON c.id = p.id),
n AS (SELECT *, length(t) < 1 AND xt <> '' AS nt, length(a) < 2 AND xa <> '' AS na, {_CODE} AS code FROM j),
f AS (SELECT *, CASE WHEN nt THEN xt ELSE t END AS ft, CASE WHEN na THEN xa ELSE a END AS fa FROM n),
k AS (SELECT *, {tokens_sql('ft')} AS k1, {tokens_sql('xt')} AS k2, {tokens_sql('fa')} AS k3, {tokens_sql('xa')} AS k4 FROM f),
s AS (SELECT *, CASE WHEN xt <> '' OR xa <> '' THEN CASE WHEN code IS NOT NULL THEN 0.30 ELSE least(0.35, CASE WHEN ft <> '' AND xt <> '' AND {jaccard_sql('k1', 'k2')} >= 0.75 THEN 0.15 ELSE 0 END + CASE WHEN fa <> '' AND xa <> '' AND {jaccard_sql('k3', 'k4')} >= 0.75 THEN 0.15 ELSE 0 END
 + CASE WHEN ft = '' AND xt <> '' THEN 0.10 ELSE 0 END + CASE WHEN fa = '' AND xa <> '' THEN 0.10 ELSE 0 END) END ELSE 0.0 END AS dicho FROM k)
""".replace("{huella}", "CASE WHEN c.brightness IS NOT NULL AND NOT isnan(c.brightness) THEN c.brightness END")


@query(_TAGS + """SELECT id, CASE WHEN nt THEN x_titulo ELSE titulo END AS titulo, CASE WHEN na THEN x_artista ELSE artista_nombre END AS artista, CASE WHEN nt THEN 'externa' ELSE 'local' END AS fuente_titulo, CASE WHEN na THEN 'externa' ELSE 'local' END AS fuente_artista, code AS isrc,
CAST(round(least(1.0, dicho + CASE WHEN huella >= 0.90 THEN 0.25 WHEN huella >= 0.75 THEN 0.15 WHEN huella IS NOT NULL THEN 0.05 ELSE 0 END), 4) AS DOUBLE) AS confianza FROM s""")
def match_fused(t: Tables) -> DataFrame:
    """The tags of every track, completed and confirmed by its analysed row; a measured column stands for the score of recognition."""
    c = t.pista_candidata.select("id", F.col("titulo").alias("x_titulo"), F.col("artista_nombre").alias("x_artista"), F.lit(None).cast("string").alias("x_isrc"), F.when(~F.isnan("brightness"), F.col("brightness")).alias("huella"))
    return E.fused(t.pistas.select("id", "titulo", "artista_nombre", "isrc").join(c, "id", "left"), True)


_HINT = f"""h AS (SELECT p.id, round_even(CAST({jaccard_sql('p.k1', 'c.k1')} * 0.40 + {jaccard_sql('p.k2', 'c.k2')} * 0.35 + CASE WHEN abs(p.d - c.d) <= 3 THEN 1.0 WHEN abs(p.d - c.d) <= 8 THEN 0.8 WHEN abs(p.d - c.d) IS NOT NULL THEN 0.35 ELSE 0.5 END * 0.15 AS DOUBLE), 4) AS pista
 FROM (SELECT id, duracion_seg AS d, {tokens_sql(strip_sql('titulo'))} AS k1, {tokens_sql('artista_nombre')} AS k2 FROM pistas) p JOIN (SELECT id, duracion_seg AS d, {tokens_sql(strip_sql('titulo'))} AS k1, {tokens_sql('artista_nombre')} AS k2 FROM pista_candidata) c ON c.id = p.id)"""


def _hints(t: Tables) -> DataFrame:
    c = t.pista_candidata.select("id", F.col("titulo").alias("x_titulo"), F.col("artista_nombre").alias("x_artista"), F.col("duracion_seg").alias("x_d"))
    j = t.pistas.select("id", "titulo", "artista_nombre", "duracion_seg").join(c, "id")
    title = E.similarity(E.strip_version(F.col("titulo")), E.strip_version(F.col("x_titulo")), True)
    return j.select("id", E.hint_evidence(title, E.similarity(F.col("artista_nombre"), F.col("x_artista"), True), F.abs(F.col("duracion_seg") - F.col("x_d")), F.lit(False)).alias("pista"))


@query(f"WITH {_HINT} SELECT * FROM h")
def match_hints(t: Tables) -> DataFrame:
    """How far the analysed row of a track supports it."""
    return _hints(t)


@query(_PAIRS + f""", e AS (SELECT id, c_id, round_even(CAST(s_titulo * 0.28 + s_artista * 0.26 + coalesce(CASE WHEN d <= 2 THEN 1.0 WHEN d <= 5 THEN 0.8 WHEN d <= 12 THEN 0.6 WHEN d IS NOT NULL THEN 0.2 END, 0.5) * 0.18 + coalesce(same_code::INT, 0) * 0.18 + coalesce(same_id::INT, 0) * 0.10 AS DOUBLE), 4) AS evidencia, coalesce(same_code, false) OR coalesce(same_id, false) AS fuerte FROM p),
w AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY evidencia DESC, c_id) AS n FROM e), b AS (SELECT id, max(c_id) FILTER (n = 1) AS c_id, bool_or(fuerte) FILTER (n = 1) AS fuerte, max(evidencia) AS evidencia, round(max(evidencia) - CASE WHEN count(*) > 1 THEN min(evidencia) ELSE 0.0 END, 6) AS brecha FROM w WHERE n <= 2 GROUP BY id), {_HINT}
SELECT b.id, c_id, evidencia, brecha FROM b JOIN h ON h.id = b.id WHERE evidencia >= 0.90 AND brecha >= 0.14 AND fuerte AND pista >= 0.8""")
def match_third(t: Tables) -> DataFrame:
    """Records whose best candidate wins on a third look."""
    df = _pairs(t, True)
    strong = F.coalesce(F.col("isrc") == F.col("c_isrc"), F.lit(False)) | F.coalesce(F.col("mb_recording_id") == F.col("c_mb_recording_id"), F.lit(False))
    return E.third_look(df.select("id", "c_id", E.second_evidence(df).alias("evidencia"), strong.alias("fuerte")), _hints(t))
