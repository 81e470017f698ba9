"""Phrases, embeddings and the fit of tracks to a phrase."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonalis.functions.text import compare_form
from tonalis.operators import intents as I
from tonalis.plans.features import known_sql
from tonalis.plans.registry import Registry
from tonalis.plans.text import cmp_sql
from tonalis.tables import Tables

query = Registry()

#: A small table of concepts for the registered queries; the operators take any.
CONCEPTS = (
    I.Concept("noche", ("noche", "de noche", "night", "late night", "nocturna"), {"night_score": 0.8, "darkness": 0.4}, 0.9, genres=("ambient",), boosts=("tranquilo",)),
    I.Concept("tranquilo", ("tranquilo", "algo tranquilo", "calma", "suave"), {"calmness": 0.7, "energy": -0.4, "night_score": 0.1}, 1.0, role="priority", genres=("folk", "jazz"), opposites=("fiesta", "entrenar")),
    I.Concept("fiesta", ("fiesta", "party"), {"club_energy": 0.8, "energy": 0.5}, 1.0, genres=("cumbia", "reggaeton"), opposites=("tranquilo",)),
    I.Concept("entrenar", ("entrenar", "correr", "the gym", "gimnasio"), {"workout_score": 0.8, "energy": 0.6}, 0.8, opposites=("tranquilo",)),
    I.Concept("manejar", ("manejar", "para manejar", "carretera"), {"focus_score": 0.5, "energy": 0.2}, 0.7),
    I.Concept("melancolia", ("melancolia", "triste", "boleros viejos"), {"melancholy": 0.8, "euphoria": -0.3}, 0.9),
    I.Concept("metal", ("metal",), {"aggressiveness": 0.7, "energy": 0.5}, 0.9, genres=("metal", "rock")),
    I.Concept("muy", ("muy", "mas", "more"), {}, role="strong"),
    I.Concept("poco", ("un poco", "apenas"), {}, role="weak"),
)
PHRASE = "algo muy tranquilo para manejar de noche sin metal"
INTENT = I.parse(PHRASE, CONCEPTS)


def _named(text: str, c: I.Concept) -> str:
    return "(" + " OR ".join(f"contains(' ' || coalesce({text}, '') || ' ', ' {a} ')" for a in c.aliases) + ")"


@query()
def session_intents(t: Tables) -> DataFrame:
    """What the prompt of every session asks for."""
    texts = t.dj_sesiones.select("id", compare_form(F.col("prompt_original")).alias("texto"))
    return I.intents(texts, CONCEPTS, "id", "texto").select("id", F.to_json("ejes").alias("ejes"), "focos", "excluidos", "generos_excluidos", "contradicciones")


_TAGS = {c.name: f"coalesce(list_sum(list_transform(vibe_tags, lambda x: CASE WHEN {_named('x', c)} THEN 1 ELSE 0 END)), 0)" for c in CONCEPTS}
_TITLE = cmp_sql("concat_ws(' ', titulo, artista_nombre)")


def _axis(a: str) -> str:
    parts = [f"coalesce(({known_sql(f)} - 0.5) * 2.0, 0.0)" for f, x in I.FEATURE_AXES.items() if x == a]
    parts += [f"{_TAGS[c.name]} * {c.axes[a] * 0.5}" for c in CONCEPTS if a in c.axes]
    return " + ".join(parts)


def _concept(c: I.Concept) -> str:
    genre = f"CASE WHEN lower(trim(genero)) IN ({', '.join(repr(g) for g in c.genres)}) THEN 1.0 ELSE 0.0 END + " if c.genres else ""
    return f"{genre}{_TAGS[c.name]} * {c.weight} + CASE WHEN {_named(_TITLE, c)} THEN {c.weight * 0.5} ELSE 0.0 END"


_DIMS = [f"CAST({_axis(a)} AS DOUBLE)" for a in I.AXES] + [f"CAST({_concept(c)} AS DOUBLE)" for c in CONCEPTS]
_VECTORS = f"SELECT id, {', '.join(f'{d} AS v{k}' for k, d in enumerate(_DIMS))} FROM pista_candidata"
_NORM = "sqrt(" + " + ".join(f"v{k} * v{k}" for k in range(len(_DIMS))) + ")"


@query(f"WITH v AS ({_VECTORS}) SELECT id, round({_NORM}, 6) AS norma, round(v0, 6) AS energia, round(v{len(I.AXES)}, 6) AS noche FROM v")
def track_embeddings(t: Tables) -> DataFrame:
    """The embedding of every track: its length, the first axis and the first concept."""
    v = t.pista_candidata.select("id", I.track_vector(CONCEPTS).alias("v"))
    return v.select("id", F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)), 6).alias("norma"), F.round(F.col("v")[0], 6).alias("energia"), F.round(F.col("v")[len(I.AXES)], 6).alias("noche"))


def _value(a: str) -> str:
    return f"((CASE WHEN valores['{a}'] IS NULL OR isnan(valores['{a}']) THEN 0.5 ELSE valores['{a}'] END - 0.5) * 2.0)"


_FIT = "(" + " + ".join(f"{_value(a)} * {w}" for a, w in INTENT.axes.items()) + f") / {sum(map(abs, INTENT.axes.values()))}"
_FOCUS = "".join(
    f" + CASE WHEN {s} > 0 THEN least(0.15, ({s}) / {len(c.axes)}) ELSE 0.0 END" for c in CONCEPTS if c.name in INTENT.focus for s in ["(" + " + ".join(f"{_value(a)} * {d}" for a, d in c.axes.items()) + ")"]
)
_ASKED = sum(x * x for x in INTENT.vector) ** 0.5
_SCORED = f"""WITH v AS ({_VECTORS}), s AS (SELECT p.id, p.titulo, p.genero, p.vibe_tags, 0.75 * ({_FIT}{_FOCUS}) + 0.25 * CASE WHEN {_NORM} = 0 THEN 0.0 ELSE ({" + ".join(f"v{k} * {x}" for k, x in enumerate(INTENT.vector) if x) or "0.0"}) / ({_ASKED} * {_NORM}) END AS puntaje
FROM pista_candidata p JOIN v ON v.id = p.id JOIN ejes_pista e ON e.pista_id = p.id WHERE e.valores IS NOT NULL)
"""


def _scored(t: Tables) -> DataFrame:
    j = t.pista_candidata.join(t.ejes_pista.filter("valores is not null").select(F.col("pista_id").alias("id"), "valores"), "id")
    return j.select("id", "titulo", "genero", "vibe_tags", I.track_score(INTENT, CONCEPTS).alias("puntaje"))


@query(_SCORED + "SELECT id, round(puntaje, 6) AS puntaje FROM s")
def intent_track_scores(t: Tables) -> DataFrame:
    """How well every analysed track fits a phrase: axes, foci and embedding."""
    return _scored(t).select("id", F.round("puntaje", 6).alias("puntaje"))


_OUT = sorted({g for g in INTENT.excluded_genres} | {g for c in CONCEPTS if c.name in INTENT.excluded for g in c.genres})
_HALVED = " * ".join(["puntaje"] + [f"CASE WHEN list_has_any(list_transform(coalesce(vibe_tags, []), lambda x: lower(x)), [{', '.join(repr(a) for a in c.aliases)}]) THEN 0.5 ELSE 1.0 END" for c in CONCEPTS if c.name in INTENT.excluded])


@query(_SCORED + f"SELECT id, titulo, round({_HALVED}, 6) AS puntaje FROM s WHERE NOT coalesce(lower(genero) IN ({', '.join(repr(g) for g in _OUT)}), false) ORDER BY round({_HALVED}, 6) DESC, id LIMIT 40")
def intent_choice(t: Tables) -> DataFrame:
    """The best tracks for a phrase after its exclusions."""
    best = I.without_excluded(_scored(t), INTENT, CONCEPTS)
    return best.select("id", "titulo", F.round("puntaje", 6).alias("puntaje")).orderBy(F.desc("puntaje"), "id").limit(40)


@query("SELECT DISTINCT pista_id FROM score_detalle WHERE motivo_descarte IS NOT NULL AND motivo_descarte IN (SELECT motivo_descarte FROM score_detalle WHERE motivo_descarte IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, motivo_descarte LIMIT 2)")
def session_exclusions(t: Tables) -> DataFrame:
    """The tracks that sessions left out for one of the two most frequent reasons."""
    s = t.score_detalle
    kinds = [r.motivo_descarte for r in s.filter("motivo_descarte is not null").groupBy("motivo_descarte").count().orderBy(F.desc("count"), "motivo_descarte").limit(2).collect()]
    return I.rejected_items(s, "pista_id", "motivo_descarte", kinds)


@query(f"""SELECT p.id, p.titulo, {known_sql('c.energy')} AS energy, e.valores IS NOT NULL AS con_ejes FROM pistas p LEFT JOIN pista_candidata c ON c.id = p.id LEFT JOIN ejes_pista e ON e.pista_id = p.id
WHERE p.estado = 'biblioteca' AND p.id NOT IN (SELECT pista_id FROM score_detalle WHERE descartada) ORDER BY p.id LIMIT 5000""")
def session_pool(t: Tables) -> DataFrame:
    """What a session chooses from: library tracks with features and axes, without rejected ones."""
    out = t.score_detalle.filter("descartada").select(F.col("pista_id").alias("id")).distinct()
    features = t.pista_candidata.select("id", F.when(~F.isnan("energy"), F.col("energy")).alias("energy"))
    return I.pool(t.pistas, features, t.ejes_pista, out).select("id", "titulo", "energy", F.col("valores").isNotNull().alias("con_ejes"))
