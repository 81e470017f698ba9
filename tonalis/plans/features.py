"""Tags, axes, intents and sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonalis.functions.text import compare_form
from tonalis.operators import features as U
from tonalis.plans.registry import Registry
from tonalis.plans.text import cmp_sql
from tonalis.tables import Tables

query = Registry()


def known_sql(c: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL AND NOT isnan({c}) THEN {c} END"


def clip_sql(c: str, missing: str = "NULL") -> str:
    return f"coalesce(CASE WHEN {c} IS NOT NULL AND NOT isnan({c}) THEN least(1.0, greatest(0.0, {c})) END, {missing})"


_RULE = " UNION ALL ".join(f"SELECT id, '{t}' AS tag, round_even({known_sql(c)}, 4) AS puntaje, 'reglas' AS fuente FROM pista_candidata WHERE {known_sql(c)} >= 0.35" for t, c in U.RULE_TAGS.items())
_MODEL = " UNION ALL ".join(f"SELECT id, '{t}' AS tag, round_even({clip_sql(c)}, 4) AS puntaje, 'modelo' AS fuente FROM pista_candidata WHERE {clip_sql(c)} >= 0.35" for t, c in U.MODEL_TAGS.items())


@query(_RULE)
def tags_by_rule(t: Tables) -> DataFrame:
    return U.tags(t.pista_candidata, U.RULE_TAGS, "reglas", False)


@query(_MODEL)
def tags_by_model(t: Tables) -> DataFrame:
    return U.tags(t.pista_candidata, U.MODEL_TAGS, "modelo", True)


@query(f"SELECT id, list_sort(list(DISTINCT tag)) AS tags FROM ({_RULE} UNION ALL {_MODEL}) WHERE puntaje >= 0.4 GROUP BY id")
def tags_per_track(t: Tables) -> DataFrame:
    return U.tag_list(U.tags(t.pista_candidata, U.RULE_TAGS, "reglas", False).unionByName(U.tags(t.pista_candidata, U.MODEL_TAGS, "modelo", True)))


_AXIS_SQL = {
    "energy": ["energy", "arousal_proxy"], "danceability": ["danceability_model", "danceability_proxy"], "calmness": ["mood_relaxed", "calmness_proxy"], "melancholy": ["mood_sad", "melancholy_proxy"],
    "euphoria": ["mood_happy", "valence_proxy"], "brightness": ["brightness"], "night_score": ["night_score_proxy"],
}


@query("SELECT id, " + ", ".join(f"coalesce(least(1.0, greatest(0.0, coalesce({', '.join(known_sql(c) for c in cs)}))), 0.5) AS {k}" if False else f"CASE WHEN coalesce({', '.join(known_sql(c) for c in cs)}) IS NULL THEN 0.5 ELSE least(1.0, greatest(0.0, coalesce({', '.join(known_sql(c) for c in cs)}))) END AS {k}" for k, cs in _AXIS_SQL.items()) + " FROM pista_candidata")
def axes_direct(t: Tables) -> DataFrame:
    """The axes that come straight from a feature."""
    return U.axes(t.pista_candidata).select("id", *[F.element_at("valores", k).alias(k) for k in _AXIS_SQL])


@query()
def axes_all(t: Tables) -> DataFrame:
    """All 24 axes, those from model labels too."""
    return U.axes(t.pista_candidata)


@query("""WITH e AS (SELECT pista_id, unnest(map_entries(valores)) AS e FROM ejes_pista WHERE valores IS NOT NULL),
r AS (SELECT pista_id, e.key AS k, e.value AS v, row_number() OVER (PARTITION BY pista_id ORDER BY e.value DESC, e.key) AS n FROM e WHERE e.value IS NOT NULL AND NOT isnan(e.value))
SELECT pista_id, k AS clave, round(v, 6) AS valor, CAST(n AS INT) AS puesto FROM r WHERE n <= 3""")
def axes_top(t: Tables) -> DataFrame:
    """The three strongest axes of every track."""
    rows = t.ejes_pista.filter("valores is not null").select("pista_id", F.posexplode(U.top_entries(F.col("valores"), 3)).alias("p", "e"))
    return rows.select("pista_id", "e.clave", F.round("e.valor", 6).alias("valor"), (F.col("p") + 1).alias("puesto"))


@query("""WITH e AS (SELECT label, embedding, unnest(range(0, len(embedding))) AS indice FROM embeddings) SELECT label, CAST(indice AS INT) AS indice, round(avg(CAST(embedding[indice + 1] AS DOUBLE)), 6) AS media FROM e GROUP BY 1, 2""")
def mean_vectors(t: Tables) -> DataFrame:
    """The mean embedding of every label."""
    e = t.embeddings.select("label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return U.mean_vector(e, "label", "v").withColumn("media", F.round("media", 6))


@query("""WITH e AS (SELECT pista_id, unnest(map_entries(valores)) AS e FROM ejes_pista WHERE valores IS NOT NULL) SELECT e.key AS eje, count(*) AS n, round(sum(e.value), 4) AS suma FROM e WHERE e.value IS NOT NULL AND NOT isnan(e.value) GROUP BY 1""")
def axis_votes(t: Tables) -> DataFrame:
    """The sum of the values of every axis."""
    return t.ejes_pista.select(F.explode("valores").alias("eje", "v")).filter("v is not null and not isnan(v)").groupBy("eje").agg(F.count("*").alias("n"), F.round(F.sum("v"), 4).alias("suma"))


def _v(c: str) -> str:
    return clip_sql(c, "0.0")


_BPM = "coalesce(" + known_sql("bpm") + ", 0.0)"
_INTENT_SQL = {
    "sad": f"0.45 * {_v('melancholy_proxy')} + 0.25 * (1 - {_v('valence_proxy')}) + 0.15 * {_v('calmness_proxy')} + 0.15 * {_v('mood_sad')}",
    "happy": f"0.45 * {_v('valence_proxy')} + 0.20 * {_v('energy')} + 0.20 * {_v('mood_happy')} + 0.15 * {_v('brightness')}",
    "party": f"0.35 * {_v('party_score_proxy')} + 0.25 * {_v('danceability_proxy')} + 0.20 * {_v('energy')} + 0.20 * greatest({_v('mood_party')}, {_v('danceability_model')})",
    "workout": f"0.40 * {_v('workout_score_proxy')} + 0.30 * {_v('energy')} + 0.20 * least(1.0, greatest(0.0, {_BPM} / 170.0)) + 0.10 * {_v('arousal')}",
    "focus": f"0.35 * {_v('calmness_proxy')} + 0.30 * {_v('focus_score_proxy')} + 0.20 * {_v('mood_relaxed')} + 0.15 * (1 - {_v('aggressiveness_proxy')})",
    "dark": f"0.45 * {_v('night_score_proxy')} + 0.35 * {_v('darkness_proxy')} + 0.20 * {_v('melancholy_proxy')}",
    "intense": f"0.35 * {_v('aggressiveness_proxy')} + 0.30 * {_v('energy')} + 0.20 * {_v('mood_aggressive')} + 0.15 * {_v('arousal')}",
    "soft": f"0.45 * (1 - {_v('energy')}) + 0.30 * {_v('calmness_proxy')} + 0.25 * (1 - {_v('aggressiveness_proxy')})",
    "fast": f"0.70 * least(1.0, greatest(0.0, {_BPM} / 180.0)) + 0.30 * {_v('energy')}",
    "slow": f"0.65 * (1 - least(1.0, greatest(0.0, {_BPM} / 160.0))) + 0.35 * {_v('calmness_proxy')}",
}


@query("SELECT id, " + ", ".join(f"CAST(round({s}, 7) AS DOUBLE) AS {k}" for k, s in _INTENT_SQL.items()) + " FROM pista_candidata")
def intent_scores(t: Tables) -> DataFrame:
    """The fit of every track to every intent, in one scan."""
    return t.pista_candidata.select("id", *[F.round(U.intent_score(k), 7).alias(k) for k in _INTENT_SQL])


@query(f"SELECT id, titulo, round(0.6 * ({_INTENT_SQL['sad']}) + 0.4 * ({_INTENT_SQL['slow']}), 7) AS puntaje FROM pista_candidata WHERE round(0.6 * ({_INTENT_SQL['sad']}) + 0.4 * ({_INTENT_SQL['slow']}), 7) >= 0.35 ORDER BY puntaje DESC, id LIMIT 30")
def discovery_rank(t: Tables) -> DataFrame:
    """Tracks for a mixed intent from a threshold on, best first."""
    s = F.round(U.weighted_intents({"sad": 0.9, "slow": 0.6}), 7)
    return t.pista_candidata.select("id", "titulo", s.alias("puntaje")).filter("puntaje >= 0.35").orderBy(F.desc("puntaje"), "id").limit(30)


_SECTIONS = {"Más fiesteras": clip_sql("party_score_proxy", "0.0"), "Más bailables": clip_sql("danceability_proxy", "0.0"), "Energía alta": clip_sql("energy", "0.0")}


def _sections_sql() -> str:
    ctes, used = [], []
    for k, (name, s) in enumerate(_SECTIONS.items()):
        free = f"WHERE id NOT IN ({' UNION ALL '.join(f'SELECT id FROM s{u}' for u in used)})" if used else ""
        ctes.append(f"s{k} AS (SELECT '{name}' AS seccion, CAST(row_number() OVER (ORDER BY round({s}, 6) DESC, id) AS INT) AS puesto, id, round({s}, 6) AS puntaje FROM pista_candidata {free} QUALIFY puesto <= 8)")
        used.append(k)
    return f"WITH {', '.join(ctes)} " + " UNION ALL ".join(f"SELECT * FROM s{k}" for k in used)


@query(_sections_sql())
def discovery_sections(t: Tables) -> DataFrame:
    """Three sections of a party, no track twice."""
    specs = {"Más fiesteras": U.clip(F.col("party_score_proxy"), 0.0), "Más bailables": U.clip(F.col("danceability_proxy"), 0.0), "Energía alta": U.clip(F.col("energy"), 0.0)}
    return U.sections(t.pista_candidata, specs)


def _weight(k: str) -> str:
    hits = " + ".join(f"contains(q, '{w}')::INT" for w in U.KEYWORDS[k])
    phrase = "greatest(0.0, " + ", ".join(f"CASE WHEN contains(q, '{p}') THEN {w} ELSE 0.0 END" for p, i, w in U.PHRASES if i == k) + ")" if any(i == k for _, i, _ in U.PHRASES) else "0.0"
    w = f"CASE WHEN {hits} > 0 THEN least(1.0, 0.75 + ({hits}) * 0.15) ELSE {phrase} END"
    return f"CASE WHEN (contains(q, 'baja energia') OR contains(q, 'energia baja')) AND NOT regexp_matches(q, 'entren|gym|correr|workout|run|caminar') THEN 0.0 ELSE {w} END" if k == "workout" else w


@query(f"WITH x AS (SELECT id, {cmp_sql('prompt_original')} AS q FROM dj_sesiones) SELECT * FROM (" + " UNION ALL ".join(f"SELECT id, '{k}' AS intencion, CAST({_weight(k)} AS DOUBLE) AS peso FROM x" for k in U.KEYWORDS) + ") WHERE peso > 0")
def prompt_intents(t: Tables) -> DataFrame:
    """The weighted intents of every session's prompt."""
    return t.dj_sesiones.select("id", F.explode(U.intents_of(compare_form(F.col("prompt_original")))).alias("intencion", "peso"))


@query("""SELECT count(*) AS pistas, count(*) FILTER (mood_sad IS NOT NULL) AS profundas, round(count(*) FILTER (mood_sad IS NOT NULL) / count(*), 6) AS parte FROM pista_candidata""")
def discovery_coverage(t: Tables) -> DataFrame:
    n = F.count("*")
    return t.pista_candidata.agg(n.alias("pistas"), F.count_if(F.col("mood_sad").isNotNull()).alias("profundas"), F.round(F.count_if(F.col("mood_sad").isNotNull()) / n, 6).alias("parte"))


_P = {"tempo": "bpm", "rms": "energy / 3", "spread": "mood_relaxed / 2", "onset": "danceability_proxy * 5", "centroid": "brightness * 4000", "zero": "aggressiveness_proxy / 5"}


def _c01(x: str) -> str:
    return f"least(1.0, greatest(0.0, {x}))"


@query(f"""WITH r AS (SELECT id, bpm AS tempo, energy / 3 AS rms, mood_relaxed / 2 AS spread, danceability_proxy * 5 AS onset, brightness * 4000 AS centroid, aggressiveness_proxy / 5 AS zero FROM pista_candidata WHERE bpm > 0 AND NOT isnan(bpm) AND NOT isnan(energy) AND NOT isnan(mood_relaxed) AND NOT isnan(danceability_proxy) AND NOT isnan(brightness) AND NOT isnan(aggressiveness_proxy)),
a AS (SELECT *, {_c01('centroid / 4000')} AS b, {_c01('rms * 3')} AS e FROM r), c AS (SELECT *, {_c01('0.6 * e + 0.4 * ' + _c01('tempo / 180'))} AS ar FROM a), d AS (SELECT *, 1 - ar AS ca, {_c01('0.5 * b + 0.5 * ar')} AS va FROM c), f AS (SELECT *, {_c01('(1 - va) * 0.7 + ca * 0.3')} AS me, {_c01('0.5 * ' + _c01('tempo / 140') + ' + 0.5 * ' + _c01('onset / 5'))} AS da FROM d)
SELECT id, round(va, 8) AS valence, round(me, 8) AS melancholy, round({_c01('0.4 * da + 0.4 * e + 0.2 * va')}, 8) AS party, round({_c01('0.5 * e + 0.3 * ' + _c01('tempo / 160') + ' + 0.2 * ' + _c01('onset / 6'))}, 8) AS workout, round({_c01('0.5 * ca + 0.3 * (1 - spread) + 0.2 * (1 - zero * 5)')}, 8) AS focus, round({_c01('0.6 * (1 - b) + 0.4 * me')}, 8) AS night FROM f""")
def feature_proxies(t: Tables) -> DataFrame:
    """Proxies from raw descriptors, here recovered from the stored features."""
    names = ("bpm", "energy", "mood_relaxed", "danceability_proxy", "brightness", "aggressiveness_proxy")
    rows = t.pista_candidata.filter(F.col("bpm") > 0)
    for n in names:
        rows = rows.filter(F.col(n).isNotNull() & ~F.isnan(n))
    p = U.proxies(F.col("bpm"), F.col("energy") / 3, F.col("mood_relaxed") / 2, F.col("danceability_proxy") * 5, F.col("brightness") * 4000, F.col("aggressiveness_proxy") / 5)
    return rows.select("id", *[F.round(p[k], 8).alias(k) for k in ("valence", "melancholy", "party", "workout", "focus", "night")])


@query("""SELECT doc_id, CASE WHEN contains(lower(text), 'no module named') THEN CASE WHEN contains(lower(text), 'librosa') THEN 'librosa_missing' WHEN contains(lower(text), 'soundfile') THEN 'soundfile_missing' WHEN contains(lower(text), 'audioread') THEN 'audioread_missing' ELSE 'dependency_missing' END WHEN contains(lower(text), 'no such file') THEN 'file_not_found' WHEN contains(lower(text), 'codec') OR contains(lower(text), 'format') OR contains(lower(text), 'decode') THEN 'codec_error' WHEN contains(lower(text), 'memory') THEN 'memory_error' ELSE 'analysis_error' END AS clase FROM documents WHERE tipo = 'nota_import'""")
def error_classes(t: Tables) -> DataFrame:
    """The kind of failure that an import note tells of."""
    return t.documents.filter("tipo = 'nota_import'").select("doc_id", U.error_class(F.col("text")).alias("clase"))


_WANTED = {"melancholy": 0.8, "calmness": 0.6, "energy": -0.5}


@query("""WITH e AS (SELECT pista_id, valores['melancholy'] AS m, valores['calmness'] AS c, valores['energy'] AS e FROM ejes_pista WHERE valores IS NOT NULL)
SELECT pista_id, round(((CASE WHEN m IS NULL OR isnan(m) THEN 0.5 ELSE m END - 0.5) * 1.6 + (CASE WHEN c IS NULL OR isnan(c) THEN 0.5 ELSE c END - 0.5) * 1.2 - (CASE WHEN e IS NULL OR isnan(e) THEN 0.5 ELSE e END - 0.5) * 1.0) / 1.9::DOUBLE, 8) AS puntaje FROM e""")
def axes_fit(t: Tables) -> DataFrame:
    """How well every track fits wanted axes."""
    return t.ejes_pista.filter("valores is not null").select("pista_id", F.round(U.axes_score(F.col("valores"), _WANTED), 8).alias("puntaje"))


_LABEL = "CASE intencion " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in U.INTENT_LABELS.items()) + " END"


@query(f"WITH x AS (SELECT id, {cmp_sql('prompt_original')} AS q FROM dj_sesiones), w AS (SELECT * FROM (" + " UNION ALL ".join(f"SELECT id, '{k}' AS intencion, CAST({_weight(k)} AS DOUBLE) AS peso FROM x" for k in U.KEYWORDS) + f""") WHERE peso > 0),
g AS (SELECT id, count(*) AS n, min(intencion) AS una, string_agg({_LABEL}, ' + ' ORDER BY intencion) AS nombres FROM w GROUP BY id) SELECT x.id, CASE WHEN g.n IS NULL THEN 'generic' WHEN g.n = 1 THEN g.una ELSE 'mixed' END AS intencion, CASE WHEN g.n IS NULL THEN 'Selección musical general' ELSE 'Selección ' || nombres END AS etiqueta FROM x LEFT JOIN g USING (id)""")
def prompt_summaries(t: Tables) -> DataFrame:
    """What every prompt asks for in one word, with a label; prompts without an intent are generic."""
    return t.dj_sesiones.select("id", U.intent_summary(compare_form(F.col("prompt_original"))).alias("s")).select("id", "s.intencion", "s.etiqueta")


@query(f"""SELECT id, {clip_sql('round(x * 1.5, 6)')} AS mood_sad, {clip_sql('round(v, 6)')} AS valence, CASE WHEN id % 3 = 0 THEN NULL ELSE 200 END AS embeddings_dim FROM (SELECT id, {known_sql('mood_sad')} AS x, {known_sql('valence')} AS v FROM pista_candidata WHERE mood_sad IS NOT NULL AND valence IS NOT NULL)""")
def model_columns(t: Tables) -> DataFrame:
    """The outputs of models as JSON turned into columns; here made from the stored features."""
    rows = t.pista_candidata.filter("mood_sad is not null and valence is not null")
    real = lambda c: F.when(~F.isnan(c), c)
    out = F.to_json(F.struct(F.struct(real(F.round(F.col("mood_sad") * 1.5, 6)).alias("score")).alias("mood_sad"), F.struct(real(F.round("valence", 6)).alias("valence")).alias("arousal_valence"), F.when(F.col("id") % 3 != 0, F.struct(F.lit(200).alias("dim"))).alias("msd_musicnn_embeddings")))
    return rows.select("id", U.model_fields(out).alias("m")).select("id", "m.mood_sad", "m.valence", "m.embeddings_dim")


@query(f"""SELECT p.id, p.titulo, b.titulo AS album, round(({_INTENT_SQL['focus']})::DOUBLE, 6) AS puntaje FROM pistas p JOIN (SELECT id AS cid, * EXCLUDE (id, titulo, album_id, artista_nombre, artista_id, genero, duracion_seg) FROM pista_candidata WHERE energy IS NOT NULL AND NOT isnan(energy)) c ON c.cid = p.id LEFT JOIN albums b ON b.id = p.album_id
WHERE p.estado = 'biblioteca' AND round(({_INTENT_SQL['focus']})::DOUBLE, 6) >= 0.35 ORDER BY puntaje DESC, p.id LIMIT 30""")
def discovery_library(t: Tables) -> DataFrame:
    """Library tracks that were analysed, with their album, for one intent from a threshold on."""
    c = t.pista_candidata.filter("energy is not null and not isnan(energy)").select("id", F.round(U.intent_score("focus"), 6).alias("puntaje")).filter("puntaje >= 0.35")
    p = t.pistas.filter("estado = 'biblioteca'").select("id", "titulo", "album_id")
    b = t.albums.select(F.col("id").alias("album_id"), F.col("titulo").alias("album"))
    return p.join(c, "id").join(b, "album_id", "left").select("id", "titulo", "album", "puntaje").orderBy(F.desc("puntaje"), "id").limit(30)
