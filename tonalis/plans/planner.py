"""Vectors, transitions and session plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonalis.functions import vectors as V
from tonalis.functions.text import compare_form
from tonalis.operators import planner as G
from tonalis.operators.library import number_rows
from tonalis.operators.listening import membership
from tonalis.plans.features import known_sql
from tonalis.plans.registry import Registry
from tonalis.plans.text import cmp_sql
from tonalis.tables import Tables

query = Registry()


@query("SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS similitud FROM embeddings ORDER BY similitud DESC, vec_id LIMIT 20")
def cosine_top(t: Tables) -> DataFrame:
    """The twenty vectors most like the first one."""
    first = t.embeddings.filter("vec_id = 0").select("embedding").scalar()
    return t.embeddings.withColumn("_q", first).select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("_q")), 6).alias("similitud")).orderBy(F.desc("similitud"), "vec_id").limit(20)


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norma, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS primera FROM embeddings")
def vector_norms(t: Tables) -> DataFrame:
    e = F.transform("embedding", lambda x: x.cast("double"))
    return t.embeddings.select("vec_id", F.round(V.norm(e), 6).alias("norma"), F.round(V.normalised(e)[0], 6).alias("primera"))


def _code(k: str, m: str) -> str:
    look = lambda table, letter: "CASE trim(" + k + ") " + " ".join(f"WHEN '{a}' THEN '{b}{letter}'" for a, b in table.items()) + " END"
    return f"CASE WHEN coalesce(contains(lower({m}), 'min'), false) THEN {look(G.MINOR, 'A')} ELSE {look(G.MAJOR, 'B')} END"


@query(f"SELECT id, {_code('key_name', 'mode')} AS clave FROM pista_candidata")
def wheel_codes(t: Tables) -> DataFrame:
    return t.pista_candidata.select("id", G.wheel_code(F.col("key_name"), F.col("mode")).alias("clave"))


def _distance(a: str, b: str) -> str:
    d = f"least(abs({a}[:-2]::INT - {b}[:-2]::INT), 12 - abs({a}[:-2]::INT - {b}[:-2]::INT))"
    same = f"right({a}, 1) = right({b}, 1)"
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN 99 WHEN {d} = 0 AND {same} THEN 0 WHEN {d} = 0 OR ({d} = 1 AND {same}) THEN 1 WHEN {d} = 2 AND {same} THEN 2 ELSE 3 END"


_CODES = [f"{n}{x}" for x in "AB" for n in range(1, 13)]


@query(f"WITH c AS (SELECT unnest({_CODES}) AS c) SELECT a.c AS a, b.c AS b, {_distance('a.c', 'b.c')} AS distancia FROM c a, c b")
def wheel_distances(t: Tables) -> DataFrame:
    """The distance between every two of the 24 codes."""
    one = F.array(*[F.lit(c) for c in _CODES])
    pairs = t.spark.range(1).select(F.explode(one).alias("a")).select("a", F.explode(one).alias("b"))
    return pairs.select("a", "b", G.key_distance(F.col("a"), F.col("b")).alias("distancia"))


_TEMPO = "CASE WHEN bpm IS NULL OR b2 IS NULL OR bpm <= 0 OR b2 <= 0 THEN 0.5 WHEN db <= 8 THEN 1.0 WHEN db <= 16 THEN 1.0 - 0.5 * (db - 8) / 8 WHEN db <= 30 THEN 0.5 - 0.5 * (db - 16) / 14 ELSE 0.0 END"
_ENERGY = "CASE WHEN energy IS NULL OR e2 IS NULL THEN 0.5 WHEN abs(e2 - energy) <= 0.10 THEN 1.0 WHEN abs(e2 - energy) <= 0.25 THEN 1.0 - (abs(e2 - energy) - 0.10) / 0.30 ELSE greatest(0.0, 0.5 - (abs(e2 - energy) - 0.25) * 2) END"
_SEQUENCE = f"""WITH m AS (SELECT sesion_id AS lista_id, pista_id, min(calculado_en) AS agregado FROM score_detalle GROUP BY 1, 2), o AS (SELECT lista_id, pista_id, row_number() OVER (PARTITION BY lista_id ORDER BY agregado, pista_id) AS posicion FROM m),
c AS (SELECT o.*, {known_sql('bpm')} AS bpm, {known_sql('energy')} AS energy, {_code('key_name', 'mode')} AS clave FROM o JOIN pista_candidata p ON p.id = o.pista_id),
n AS (SELECT c.*, d.pista_id AS siguiente, d.bpm AS b2, d.energy AS e2, d.clave AS k2, least(abs(c.bpm - d.bpm), abs(c.bpm * 2 - d.bpm), abs(c.bpm / 2 - d.bpm)) AS db FROM c JOIN c d ON d.lista_id = c.lista_id AND d.posicion = c.posicion + 1),
f AS (SELECT *, CAST({_TEMPO} AS DOUBLE) AS fb, {_distance('clave', 'k2')} AS dist, CAST({_ENERGY} AS DOUBLE) AS fe FROM n),
s AS (SELECT *, CAST(CASE dist WHEN 99 THEN 0.5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.85 WHEN 2 THEN 0.6 ELSE 0.3 END AS DOUBLE) AS fk FROM f)
"""


def _sequence(t: Tables) -> DataFrame:
    order = number_rows(membership(t.score_detalle), ["lista_id"], [F.asc("agregado"), F.asc("pista_id")]).select("lista_id", "pista_id", "posicion")
    p = t.pista_candidata.select(F.col("id").alias("pista_id"), G.measurement("bpm").alias("bpm"), G.measurement("energy").alias("energy"), G.wheel_code(F.col("key_name"), F.col("mode")).alias("clave"))
    return G.neighbours(order.join(p, "pista_id"), "lista_id", "posicion")


@query(_SEQUENCE + "SELECT lista_id, posicion, pista_id, siguiente, round(0.45 * fb + 0.30 * fk + 0.25 * fe, 8) AS puntaje, round(fb, 8) AS f_bpm, round(fk, 8) AS f_tono, round(fe, 8) AS f_energia, dist AS distancia FROM s")
def transition_scores(t: Tables) -> DataFrame:
    """Every step of every session: tempo, key and energy of neighbours."""
    x = G.with_transition(_sequence(t)).withColumnRenamed("sig_pista_id", "siguiente")
    return x.select("lista_id", "posicion", "pista_id", "siguiente", *[F.round(c, 8).alias(c) for c in ("puntaje", "f_bpm", "f_tono", "f_energia")], "distancia")


_HARMONIC = "0.25 * fb + 0.55 * fk + 0.20 * CASE WHEN energy IS NULL OR e2 IS NULL THEN 0.5 ELSE 1.0 - least(1.0, abs(e2 - energy)) END"


@query(_SEQUENCE + f""", h AS (SELECT *, {_HARMONIC} AS p FROM s) SELECT lista_id, posicion, CASE WHEN p >= 0.80 AND dist <= 1 AND fb >= 0.85 THEN 'mix_armonico' ELSE 'crossfade' END AS tecnica, CAST(CASE WHEN p >= 0.80 AND dist <= 1 AND fb >= 0.85 THEN 8.0 WHEN p >= 0.6 THEN 5.0 ELSE 3.0 END AS DOUBLE) AS solape, round(p, 8) AS puntaje FROM h""")
def transition_techniques(t: Tables) -> DataFrame:
    """Technique and overlap of every step in the harmonic style."""
    return G.with_transition(_sequence(t), "harmonic").select("lista_id", "posicion", "tecnica", "solape", F.round("puntaje", 8).alias("puntaje"))


@query("""WITH s AS (SELECT DISTINCT sesion_id, pista_id, score_total, calculado_en FROM score_detalle WHERE score_total IS NOT NULL AND NOT isnan(score_total)), j AS (SELECT s.*, p.artista_id, p.energy FROM s JOIN pista_candidata p ON p.id = s.pista_id)
SELECT sesion_id, count(*) AS pistas, count(DISTINCT artista_id) AS artistas, round(avg(score_total), 6) AS media, count(*) FILTER (score_total >= 0.7) AS buenas, arg_min_null(energy, (calculado_en, pista_id)) AS energia_inicial, arg_max_null(energy, (calculado_en, pista_id)) AS energia_final FROM j GROUP BY 1""")
def session_summaries(t: Tables) -> DataFrame:
    s = t.score_detalle.filter("score_total is not null and not isnan(score_total)").select("sesion_id", "pista_id", "score_total", "calculado_en").distinct()
    return G.session_summary(s, t.pista_candidata.select(F.col("id").alias("pista_id"), "artista_id", "energy"))


@query("""SELECT id, round(0.35 + 0.55 * x, 6) AS progresiva, round(0.4 + 0.4 * sin(pi() * x), 6) AS onda, round(0.85 - 0.55 * x, 6) AS descendente, round(CASE WHEN x < 0.4 THEN 0.4 + 1.25 * x WHEN x < 0.7 THEN 0.9 ELSE 0.9 - 1.3 * (x - 0.7) END, 6) AS pico
FROM (SELECT id, least(1.0, greatest(0.0, energy)) AS x FROM pista_candidata WHERE energy IS NOT NULL AND NOT isnan(energy))""")
def energy_curves(t: Tables) -> DataFrame:
    """The four curves, here at times taken from a measured column."""
    x = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("energy")))
    rows = t.pista_candidata.filter("energy is not null and not isnan(energy)")
    return rows.select("id", *[F.round(G.energy_target(c, x), 6).alias(n) for c, n in (("progressive", "progresiva"), ("wave", "onda"), ("descending", "descendente"), ("peak", "pico"))])


_PHASES = [("warmup", 0.0, 0.2, 0.3), ("groove", 0.2, 0.5, 0.55), ("peak", 0.5, 0.75, 0.85), ("cooldown", 0.75, 1.0, 0.35)]


@query("""WITH p(fase, desde, hasta, objetivo) AS (VALUES ('warmup', 0.0, 0.2, 0.3), ('groove', 0.2, 0.5, 0.55), ('peak', 0.5, 0.75, 0.85), ('cooldown', 0.75, 1.0, 0.35)), q AS (SELECT *, lead(objetivo) OVER (ORDER BY desde) AS sig FROM p),
x AS (SELECT id, least(1.0, greatest(0.0, valence)) AS t FROM pista_candidata WHERE valence IS NOT NULL AND NOT isnan(valence)), j AS (SELECT id, fase, objetivo::DOUBLE AS o, sig::DOUBLE AS s, (t - desde) / (hasta - desde) AS d FROM x JOIN q ON t >= desde AND (t < hasta OR sig IS NULL))
SELECT id, fase, round(CASE WHEN d > 0.75 AND s IS NOT NULL THEN (1 - (d - 0.75) / 0.25) * o + (d - 0.75) / 0.25 * s ELSE o END, 6) AS objetivo FROM j""")
def phase_targets(t: Tables) -> DataFrame:
    """A range join of times with a profile of phases."""
    times = t.pista_candidata.filter("valence is not null and not isnan(valence)").select("id", F.col("valence").alias("t"))
    phases = t.spark.createDataFrame(_PHASES, "fase string, desde double, hasta double, objetivo double")
    return G.phase_targets(times, phases, "t").select("id", "fase", F.round("objetivo", 6).alias("objetivo"))


@query("""WITH x AS (SELECT id, duracion_seg AS d, 60.0 / bpm AS b FROM pista_candidata WHERE bpm > 0 AND NOT isnan(bpm) AND duracion_seg >= 90), y AS (SELECT *, CASE WHEN d - 48 * b < d * 0.5 THEN d * 0.10 ELSE 16 * b END AS i, CASE WHEN d - 48 * b < d * 0.5 THEN d * 0.15 ELSE 32 * b END AS o FROM x)
SELECT id, round(i, 2) AS entrada, round(greatest(i + 30.0, d - o), 2) AS salida FROM y""")
def mix_points(t: Tables) -> DataFrame:
    return t.pista_candidata.filter(~F.isnan("bpm")).select("id", G.mix_points(F.col("duracion_seg"), F.col("bpm")).alias("m")).filter("m is not null").select("id", "m.entrada", "m.salida")


@query()
def session_plans(t: Tables) -> DataFrame:
    """A greedy order for every session, from its best scored tracks."""
    s = t.score_detalle.filter("score_total is not null and not isnan(score_total) and not coalesce(descartada, false)").groupBy("sesion_id", "pista_id").agg(F.max("score_total").alias("score_total"))
    p = t.pista_candidata.select(F.col("id").alias("pista_id"), "artista_id", "duracion_seg")
    axes = t.ejes_pista.select("pista_id", *[F.col("valores")[a].alias(a) for a in G.PHASE_AXES])
    return G.plan_sessions(s.join(p, "pista_id").join(axes, "pista_id", "left"))


_ALIASES = [("noche", "noche"), ("noche", "de noche"), ("noche", "night"), ("manejar", "manejar"), ("manejar", "para manejar"), ("piano", "piano"), ("tranquilo", "algo tranquilo"), ("tranquilo", "tranquilo"), ("fiesta", "fiesta"), ("entrenar", "entrenar"), ("cena", "cenar")]
_CONCEPTS = f"""c(concepto, alias) AS (VALUES {", ".join(map(str, _ALIASES))}), x AS (SELECT id, ' ' || coalesce({cmp_sql("prompt_original")}, '') || ' ' AS t FROM dj_sesiones), k AS (SELECT DISTINCT id, concepto FROM x JOIN c ON contains(t, ' ' || alias || ' '))"""


@query(f"WITH {_CONCEPTS} SELECT * FROM k")
def session_concepts(t: Tables) -> DataFrame:
    """Concepts in the prompts of the sessions, from a small table of aliases."""
    table = _ALIASES
    texts = t.dj_sesiones.select("id", compare_form(F.col("prompt_original")).alias("texto"))
    return G.detect_concepts(texts, t.spark.createDataFrame(table, "concepto string, alias string"), "id", "texto")


@query("""WITH x AS (SELECT sesion_id, count(*) AS n, count(*) FILTER (descartada) AS fuera FROM (SELECT DISTINCT sesion_id, pista_id, descartada FROM score_detalle) GROUP BY 1) SELECT d.id, lower(d.motor_version) AS motor, x.n, x.fuera FROM dj_sesiones d JOIN x ON x.sesion_id = d.id ORDER BY d.creado_en DESC, d.id DESC LIMIT 15""")
def recent_sessions(t: Tables) -> DataFrame:
    """The newest sessions with their scored and rejected tracks."""
    x = t.score_detalle.select("sesion_id", "pista_id", "descartada").distinct().groupBy("sesion_id").agg(F.count("*").alias("n"), F.count_if("descartada").alias("fuera"))
    return t.dj_sesiones.join(x, F.col("id") == F.col("sesion_id")).orderBy(F.desc("creado_en"), F.desc("id")).limit(15).select("id", F.lower("motor_version").alias("motor"), "n", "fuera")


@query("SELECT p.id, p.titulo FROM pista_candidata p WHERE p.id NOT IN (SELECT pista_id FROM score_detalle WHERE descartada)")
def never_rejected(t: Tables) -> DataFrame:
    """Candidates that no session rejected."""
    out = t.score_detalle.filter("descartada").select(F.col("pista_id").alias("id"))
    return t.pista_candidata.select("id", "titulo").join(out, "id", "left_anti")


@query("""WITH x AS (SELECT sesion_id, unnest(razones) AS razon FROM score_detalle) SELECT razon, count(*) AS n, count(DISTINCT sesion_id) AS sesiones FROM x GROUP BY 1""")
def score_reasons(t: Tables) -> DataFrame:
    """How often each reason was given: an exploded array."""
    return t.score_detalle.select("sesion_id", F.explode("razones").alias("razon")).groupBy("razon").agg(F.count("*").alias("n"), F.countDistinct("sesion_id").alias("sesiones"))


@query(f"""WITH o AS (SELECT id, artista_id, {known_sql('energy')} AS energy, row_number() OVER (PARTITION BY artista_id ORDER BY analizado_en, id) AS n FROM pista_candidata WHERE album_id IS NOT NULL AND artista_id IS NOT NULL)
SELECT a.id, b.id AS siguiente, round(b.energy - a.energy, 6) AS salto FROM o a JOIN o b ON a.artista_id = b.artista_id AND b.n = a.n + 1""")
def energy_steps(t: Tables) -> DataFrame:
    """The step of energy to the artist's next analysed track."""
    rows = t.pista_candidata.filter("album_id is not null and artista_id is not null").select("id", "artista_id", G.measurement("energy").alias("energy"), "analizado_en")
    o = number_rows(rows, ["artista_id"], [F.asc("analizado_en"), F.asc("id")], "n").select("id", "artista_id", "energy", "n")
    return G.neighbours(o, "artista_id", "n").select("id", F.col("sig_id").alias("siguiente"), F.round(F.col("sig_energy") - F.col("energy"), 6).alias("salto"))




@query(_SEQUENCE + """, o2 AS (SELECT lista_id, CASE WHEN 0.45 * fb + 0.30 * fk + 0.25 * fe >= 0.80 AND dist <= 1 AND fb >= 0.85 THEN 8.0 WHEN 0.45 * fb + 0.30 * fk + 0.25 * fe >= 0.6 THEN 5.0 ELSE 3.0 END::DOUBLE AS solape, pista_id FROM s), d AS (SELECT o.lista_id, sum(p.duracion_seg) AS d FROM o JOIN pista_candidata p ON p.id = o.pista_id GROUP BY 1), x AS (SELECT lista_id, sum(solape) AS s FROM o2 GROUP BY 1)
SELECT d.lista_id, round(d.d, 3) AS duracion, round(d.d - coalesce(x.s, 0), 3) AS efectiva FROM d LEFT JOIN x USING (lista_id)""")
def session_blocks(t: Tables) -> DataFrame:
    """The length of every session, and what is left of it after the overlaps of its transitions."""
    m = membership(t.score_detalle).join(t.pista_candidata.select(F.col("id").alias("pista_id"), "duracion_seg"), "pista_id")
    d = m.groupBy("lista_id").agg(F.sum("duracion_seg").alias("d"))
    o = G.with_transition(_sequence(t)).groupBy("lista_id").agg(F.sum("solape").alias("s"))
    return d.join(o, "lista_id", "left").select("lista_id", F.round("d", 3).alias("duracion"), F.round(F.col("d") - F.coalesce("s", F.lit(0.0)), 3).alias("efectiva"))


@query()
def session_refined(t: Tables) -> DataFrame:
    """Planned sessions with neighbours swapped for better transitions."""
    p = t.pista_candidata.select(F.col("id").alias("pista_id"), G.measurement("bpm").alias("bpm"), G.measurement("energy").alias("energy"), G.wheel_code(F.col("key_name"), F.col("mode")).alias("clave"))
    plan = session_plans(t).select(F.col("sesion_id").alias("lista_id"), "posicion", "pista_id")
    return G.refine_order(plan.join(p, "pista_id"))


@query("SELECT event_id, CASE WHEN value / 10 <= 1.5 THEN 'alto' WHEN value / 10 <= 5 THEN 'medio' ELSE 'bajo' END AS clase FROM events")
def speed_classes(t: Tables) -> DataFrame:
    """Classes by a real-time factor, here a tenth of the events' values."""
    return t.events.select("event_id", G.speed_class(F.col("value") / 10).alias("clase"))


@query(_SEQUENCE + """SELECT lista_id, posicion, CASE WHEN posicion % 4 = 0 AND abs(bpm - b2) <= 2 THEN 'hard_cut' WHEN posicion % 4 = 1 THEN 'energy_blend' WHEN posicion % 2 = 0 AND fk >= 0.6 AND fb >= 0.6 THEN 'harmonic_mix' WHEN fb >= 0.75 THEN 'eq_kill_bass' ELSE 'filter_sweep' END AS tecnica FROM s""")
def mix_techniques(t: Tables) -> DataFrame:
    """The technique of every step, with phases and stems derived from the position."""
    s = G.with_transition(_sequence(t))
    phase = F.when(F.col("posicion") % 4 == 0, "peak").when(F.col("posicion") % 4 == 1, "release").otherwise("groove")
    return s.select("lista_id", "posicion", G.technique(phase, F.col("bpm"), F.col("sig_bpm"), F.col("f_bpm"), F.col("f_tono"), F.col("posicion") % 2 == 0).alias("tecnica"))


@query("SELECT user_id, event_id, CAST(json_extract(props, '$.k') AS INT) AS k, ts FROM events")
def session_events(t: Tables) -> DataFrame:
    """The events of every session (here a user), their JSON parsed."""
    return G.session_log(t.events, "user_id", "props")


_AXES = [("noche", "night_score", 0.8), ("noche", "darkness", 0.4), ("tranquilo", "calmness", 0.7), ("tranquilo", "energy", -0.4), ("manejar", "focus_score", 0.5), ("manejar", "energy", 0.2)]


@query(f"WITH {_CONCEPTS}, a(concepto, eje, peso) AS (VALUES {', '.join(map(str, _AXES))}) SELECT id, eje, round(sum(peso)::DOUBLE, 6) AS peso FROM k JOIN a USING (concepto) GROUP BY 1, 2")
def session_axes(t: Tables) -> DataFrame:
    """The axes that the concepts of every prompt ask for."""
    from tonalis.operators.features import concept_axes

    table = t.spark.createDataFrame(_AXES, "concepto string, eje string, peso double")
    return concept_axes(session_concepts(t), table, "id")


_OPPOSITES = [("fiesta", "tranquilo"), ("entrenar", "tranquilo"), ("fiesta", "manejar"), ("cena", "fiesta"), ("noche", "piano")]


@query(f"WITH {_CONCEPTS}, o(a, b) AS (VALUES {', '.join(map(str, _OPPOSITES))}) SELECT k.id, a, b FROM k JOIN o ON o.a = k.concepto JOIN k l ON l.id = k.id AND l.concepto = o.b")
def session_contradictions(t: Tables) -> DataFrame:
    """Prompts that ask for opposite things."""
    from tonalis.operators.features import contradictions

    pairs = t.spark.createDataFrame(_OPPOSITES, "a string, b string")
    return contradictions(session_concepts(t), pairs, "id")


@query("""WITH x AS (SELECT id, least(1.0, greatest(0.0, energy)) AS p, CASE id % 4 WHEN 0 THEN 'hard_cut' WHEN 1 THEN 'energy_blend' WHEN 2 THEN 'harmonic_mix' ELSE 'filter_sweep' END AS k FROM pista_candidata WHERE energy IS NOT NULL AND NOT isnan(energy))
SELECT id, round(CASE k WHEN 'hard_cut' THEN CASE WHEN p < 0.5 THEN 1.0 ELSE 0.0 END WHEN 'energy_blend' THEN sqrt(1 - p) WHEN 'harmonic_mix' THEN greatest(0.0, 1 - p * 0.6) ELSE 1 - p END, 6) AS sale, round(CASE k WHEN 'hard_cut' THEN CASE WHEN p < 0.5 THEN 0.0 ELSE 1.0 END WHEN 'energy_blend' THEN sqrt(p) WHEN 'harmonic_mix' THEN least(1.0, 0.4 + p * 0.6) ELSE p END, 6) AS entra FROM x""")
def mix_volumes(t: Tables) -> DataFrame:
    """Volume curves of four techniques, here at points taken from a measured column."""
    rows = t.pista_candidata.filter("energy is not null and not isnan(energy)")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("hard_cut", "energy_blend", "harmonic_mix", "filter_sweep")]), (F.col("id") % 4 + 1).cast("int"))
    return rows.select("id", G.volumes(kind, F.col("energy")).alias("v")).select("id", F.round("v.sale", 6).alias("sale"), F.round("v.entra", 6).alias("entra"))
