"""Sessions: keys, tempos and energies of neighbours, phases, and the greedy choice of an order."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonalis.operators.features import NEUTRAL, known

# The wheel position of each key, and the letter of each mode.
MAJOR = {"C": 8, "C#": 3, "D": 10, "D#": 5, "E": 12, "F": 7, "F#": 2, "G": 9, "G#": 4, "A": 11, "A#": 6, "B": 1, "Db": 3, "Eb": 5, "Gb": 2, "Ab": 4, "Bb": 6}
MINOR = {"A": 8, "A#": 3, "B": 10, "C": 5, "C#": 12, "D": 7, "D#": 2, "E": 9, "F": 4, "F#": 11, "G": 6, "G#": 1, "Bb": 3, "Db": 12, "Eb": 2, "Gb": 11, "Ab": 1}
# Share of tempo, key and energy in a transition by style.
STYLES = {"smooth": (0.45, 0.30, 0.25), "harmonic": (0.25, 0.55, 0.20), "energetic": (0.40, 0.15, 0.45), "aggressive": (0.25, 0.15, 0.60), "cinematic": (0.20, 0.30, 0.50)}
BPM_NEAR, BPM_FAR = 8.0, 30.0
PER_ARTIST, POOL, OVER = 2, 200, 1.05
MOST_PHASES = 1000
# The phases of each curve with their share of the time; what each phase asks of the axes; the axes' shares in the distance.
CURVES = {
    "progressive": (("warmup", 0.15), ("groove", 0.35), ("peak", 0.30), ("release", 0.15), ("cooldown", 0.05)),
    "peak": (("warmup", 0.10), ("groove", 0.20), ("peak", 0.45), ("release", 0.15), ("cooldown", 0.10)),
    "descending": (("warmup", 0.10), ("groove", 0.25), ("release", 0.35), ("cooldown", 0.30)),
    "wave": (("warmup", 0.15), ("groove", 0.20), ("peak", 0.25), ("groove", 0.25), ("cooldown", 0.15)),
    "stable": (("warmup", 0.10), ("groove", 0.75), ("cooldown", 0.15)),
}
PHASE_AXES = ("energy", "tension", "rhythmic_density", "brightness", "calmness")
PHASE_TARGETS = {
    "warmup": (0.45, 0.30, 0.40, 0.55, 0.55), "groove": (0.60, 0.45, 0.55, 0.55, 0.45), "peak": (0.85, 0.65, 0.75, 0.60, 0.20),
    "release": (0.55, 0.40, 0.45, 0.50, 0.55), "cooldown": (0.35, 0.25, 0.30, 0.45, 0.75),
}
PHASE_SHARES = (0.40, 0.20, 0.15, 0.10, 0.15)


def wheel_code(key: Column, mode: Column) -> Column:
    """The wheel code of a key, null if it is unknown; a mode that holds "min" is minor, any other major."""
    minor = F.coalesce(F.contains(F.lower(mode), F.lit("min")), F.lit(False))
    k = F.trim(key)

    def look(table: dict[str, int], letter: str) -> Column:
        m = F.create_map(*[x for a, b in table.items() for x in (F.lit(a), F.lit(f"{b}{letter}"))])
        return F.element_at(m, k)

    return F.when(minor, look(MINOR, "A")).otherwise(look(MAJOR, "B"))


def wheel_number(code: Column) -> Column:
    return F.substring_index(F.substring_index(code, "A", 1), "B", 1).try_cast("int")


def key_distance(a: Column, b: Column, number_a: Column | None = None, number_b: Column | None = None) -> Column:
    """0 same, 1 neighbour or change of mode, 2 two steps, 3 farther, 99 unknown."""
    d = F.abs((wheel_number(a) if number_a is None else number_a) - (wheel_number(b) if number_b is None else number_b))
    same = F.substring(a, -1, 1) == F.substring(b, -1, 1)
    near = lambda k: d.isin(k, 12 - k)
    return F.coalesce(F.when((d == 0) & same, 0).when((d == 0) | (near(1) & same), 1).when(near(2) & same, 2).when(d.isNotNull(), 3), F.lit(99))


def key_factor(distance: Column) -> Column:
    return F.when(distance == 99, 0.5).when(distance == 0, 1.0).when(distance == 1, 0.85).when(distance == 2, 0.6).otherwise(0.3)


def tempo_factor(a: Column, b: Column) -> Column:
    """1 within BPM_NEAR, also at double and half tempo, falling to 0 at BPM_FAR; unknown is neutral."""
    d = F.least(F.abs(a - b), F.abs(a * 2 - b), F.abs(a / 2 - b))
    f = F.when(d <= BPM_NEAR, 1.0).when(d <= 2 * BPM_NEAR, 1.0 - 0.5 * (d - BPM_NEAR) / BPM_NEAR).when(d <= BPM_FAR, 0.5 - 0.5 * (d - 2 * BPM_NEAR) / (BPM_FAR - 2 * BPM_NEAR)).otherwise(0.0)
    return F.when(a.isNull() | b.isNull() | (a <= 0) | (b <= 0), NEUTRAL).otherwise(f)


def energy_factor(a: Column, b: Column, style: str = "smooth") -> Column:
    """How well a step of energy suits a style; unknown is neutral."""
    d = b - a
    x = F.abs(d)
    zero = F.lit(0.0)
    # The shape of each style.
    f = {
        "smooth": F.when(x <= 0.10, 1.0).when(x <= 0.25, 1.0 - (x - 0.10) / 0.30).otherwise(F.greatest(zero, 0.5 - (x - 0.25) * 2)),
        "aggressive": F.when(x >= 0.30, 1.0).otherwise(0.5 + x),
        "energetic": F.when(d.between(0.0, 0.15), 1.0).when(d < 0, F.greatest(zero, 0.5 + d * 2)).otherwise(F.greatest(F.lit(0.3), 1.0 - (d - 0.15) * 1.5)),
        "cinematic": F.when(x <= 0.30, 1.0 - x * 0.5).otherwise(F.greatest(zero, 0.7 - (x - 0.30))),
    }.get(style, 1.0 - F.least(F.lit(1.0), x))
    return F.when(a.isNull() | b.isNull(), NEUTRAL).otherwise(f)


def with_transition(steps: DataFrame, style: str = "smooth") -> DataFrame:
    """``steps`` (bpm, clave, energy and the same of the next track as ``sig_*``) with puntaje, f_bpm, f_tono, f_energia, distancia,
    tecnica and solape. Each quantity is a column of its own, so that it is computed once.
    """
    wb, wk, we = STYLES.get(style, (0.40, 0.30, 0.30))
    c = F.col
    df = steps.withColumns({"_na": wheel_number(c("clave")), "_nb": wheel_number(c("sig_clave"))})
    df = df.withColumns({"distancia": key_distance(c("clave"), c("sig_clave"), c("_na"), c("_nb")), "f_bpm": tempo_factor(c("bpm"), c("sig_bpm")), "f_energia": energy_factor(c("energy"), c("sig_energy"), style)})
    df = df.withColumn("f_tono", key_factor(c("distancia"))).withColumn("puntaje", wb * c("f_bpm") + wk * c("f_tono") + we * c("f_energia"))
    fine = (c("puntaje") >= 0.80) & (c("distancia") <= 1) & (c("f_bpm") >= 0.85)
    if style == "aggressive":
        technique, overlap = F.lit("cut"), F.lit(0.5)
    elif style == "cinematic":
        technique, overlap = F.lit("drone"), F.lit(6.0)
    else:
        technique, overlap = F.when(fine, "mix_armonico").otherwise("crossfade"), F.when(fine, 8.0).when(c("puntaje") >= 0.6, 5.0).otherwise(3.0)
    return df.withColumns({"tecnica": technique, "solape": overlap}).drop("_na", "_nb")


def neighbours(ordered: DataFrame, group: str, position: str) -> DataFrame:
    """Each member of a session with the next one (``sig_*``), by an equi-join on the position instead of a window."""
    nxt = ordered.select(F.col(group).alias("_g"), (F.col(position) - 1).alias("_p"), *[F.col(c).alias(f"sig_{c}") for c in ordered.columns if c not in (group, position)])
    return ordered.join(nxt, (F.col(group) == F.col("_g")) & (F.col(position) == F.col("_p"))).drop("_g", "_p")


def energy_target(curve: str, t: Column) -> Column:
    """The energy that a curve asks for at time t from 0 to 1."""
    return {
        "progressive": 0.35 + 0.55 * t, "wave": 0.4 + 0.4 * F.sin(t * 3.141592653589793), "descending": 0.85 - 0.55 * t,
        "peak": F.when(t < 0.4, 0.4 + 1.25 * t).when(t < 0.7, 0.9).otherwise(0.9 - 1.3 * (t - 0.7)),
    }.get(curve, F.lit(0.55))


def phase_targets(times: DataFrame, phases: DataFrame, t: str) -> DataFrame:
    """Each time with its phase (half-open, the last one closed) and the target, which moves to the next phase's in the last quarter.

    ``phases`` (fase, desde, hasta, objetivo) is a profile of a few rows and is broadcast.
    """
    if phases.limit(MOST_PHASES + 1).count() > MOST_PHASES:
        raise ValueError(f"more than {MOST_PHASES} phases: a profile is a small table")
    w = Window.orderBy("desde")
    p = phases.withColumn("_next", F.lead("objetivo").over(w)).withColumn("_last", F.lead("desde").over(w).isNull())
    x = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(t)))
    j = times.join(F.broadcast(p), (x >= F.col("desde")) & ((x < F.col("hasta")) | F.col("_last")))
    done = (x - F.col("desde")) / F.greatest(F.col("hasta") - F.col("desde"), F.lit(1e-6))
    share = F.when((done > 0.75) & F.col("_next").isNotNull(), (done - 0.75) / 0.25).otherwise(0.0)
    return j.withColumn("objetivo", (1 - share) * F.col("objetivo") + share * F.coalesce("_next", F.lit(0.0))).drop("_next", "_last", "desde", "hasta")


def session_summary(scored: DataFrame, energies: DataFrame) -> DataFrame:
    """Per session: tracks, artists, mean score, good scores, energy of the first and the last track."""
    j = scored.join(energies, "pista_id")
    return j.groupBy("sesion_id").agg(
        F.count("*").alias("pistas"), F.countDistinct("artista_id").alias("artistas"), F.round(F.avg("score_total"), 6).alias("media"), F.count_if(F.col("score_total") >= 0.7).alias("buenas"),
        F.min_by("energy", F.struct("calculado_en", "pista_id")).alias("energia_inicial"), F.max_by("energy", F.struct("calculado_en", "pista_id")).alias("energia_final"),
    )


def mix_points(duration: Column, bpm: Column, shortest: float = 90.0) -> Column:
    """struct(entrada, salida): 16 and 32 beats from the ends, or 10 and 15 % where that would leave less than half."""
    beat = 60.0 / bpm
    tight = duration - 48 * beat < duration * 0.5
    i, o = F.when(tight, duration * 0.10).otherwise(16 * beat), F.when(tight, duration * 0.15).otherwise(32 * beat)
    return F.when((bpm > 0) & (duration >= shortest), F.struct(F.round(i, 2).alias("entrada"), F.round(F.greatest(i + 30.0, duration - o), 2).alias("salida")))


def technique(phase: Column, bpm_a: Column, bpm_b: Column, f_tempo: Column, f_key: Column, stems: Column) -> Column:
    """The technique of a transition, first rule first."""
    return (
        F.when((phase == "peak") & (F.abs(bpm_a - bpm_b) <= 2.0), "hard_cut").when(phase.isin("release", "cooldown"), "energy_blend")
        .when(stems & (f_key >= 0.6) & (f_tempo >= 0.6), "harmonic_mix").when(f_tempo >= 0.75, "eq_kill_bass").otherwise("filter_sweep")
    )


def phase_at(curve: str, t: float) -> tuple[str, tuple[float, ...]]:
    """The phase of a curve at time t from 0 to 1, and its targets on PHASE_AXES, which move to the next phase's in its last quarter."""
    phases, begin = CURVES.get(curve, CURVES["stable"]), 0.0
    for k, (name, share) in enumerate(phases):
        last = k + 1 == len(phases)
        if t < begin + share or last:
            own = PHASE_TARGETS[name]
            done = (t - begin) / max(share, 1e-6)
            part = (done - 0.75) / 0.25 if done > 0.75 and not last else 0.0
            return name, tuple((1 - part) * a + part * b for a, b in zip(own, own if last else PHASE_TARGETS[phases[k + 1][0]]))
        begin += share
    raise AssertionError


def plan_sessions(candidates: DataFrame, *, minutes: int = 60, seed: int = 7, curve: str = "progressive") -> DataFrame:
    """(sesion_id, posicion, pista_id, fase, puntaje): a greedy order for every session.

    ``candidates``: sesion_id, pista_id, artista_id, duracion_seg, score_total, and those of PHASE_AXES that are known. The POOL best of each
    session are found in Spark (group limit; the choice looks at no more by definition); the sequential choice among these runs per
    session: 65 % score and 35 % closeness to what the phase at that time asks of the axes, at most PER_ARTIST tracks of an
    artist, until 105 % of the time. The same seed gives the same order.
    """
    rank = F.row_number().over(Window.partitionBy("sesion_id").orderBy(F.desc("score_total"), "pista_id"))
    pool = candidates.withColumn("_rn", rank).filter(F.col("_rn") <= POOL).drop("_rn")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["score_total", "pista_id"], ascending=[False, True]).to_dict("records")
        rng, used, out, spent, goal = random.Random(seed), {}, [], 0.0, minutes * 60.0
        for r in rows:
            r["_axes"] = [NEUTRAL if (v := r.get(a)) is None or v != v else v for a in PHASE_AXES]
        while rows and spent < goal * OVER:
            phase, target = phase_at(curve, min(1.0, spent / goal))
            best, value = None, float("-inf")
            for r in rows:
                if r["artista_id"] == r["artista_id"] and r["artista_id"] is not None and used.get(r["artista_id"], 0) >= PER_ARTIST:
                    continue
                far = sum(w * abs(x - y) for w, x, y in zip(PHASE_SHARES, r["_axes"], target))
                v = 0.65 * r["score_total"] + 0.35 * (1 - far) + rng.uniform(-0.001, 0.001)
                if v > value:
                    best, value = r, v
            if best is None:
                break
            rows.remove(best)
            used[best["artista_id"]] = used.get(best["artista_id"], 0) + 1
            out.append((best["sesion_id"], len(out) + 1, best["pista_id"], phase, round(value, 6)))
            spent += best["duracion_seg"] if best["duracion_seg"] == best["duracion_seg"] and best["duracion_seg"] else 0.0
        return pd.DataFrame(out, columns=["sesion_id", "posicion", "pista_id", "fase", "puntaje"])

    return pool.groupBy("sesion_id").applyInPandas(choose, "sesion_id long, posicion int, pista_id long, fase string, puntaje double")


def detect_concepts(texts: DataFrame, concepts: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, concepto): concepts whose alias stands as whole words in a text, longest alias first, no overlap.

    ``concepts`` (concepto, alias) is a lookup table; it is sent to the executors, so its size is checked.
    """
    table = sorted(((r.alias, r.concepto) for r in concepts.limit(20_001).collect()), key=lambda x: (-len(x[0]), x[0]))
    if len(table) > 20_000:
        raise ValueError("more than 20000 aliases: join on tokens instead")

    def find(batches):
        for b in batches:
            out = []
            for i, t in zip(b["i"], b["t"]):
                left = f" {t or ''} "
                for alias, concept in table:
                    if f" {alias} " in left:
                        left = left.replace(f" {alias} ", " \x00 ")
                        out.append((i, concept))
            yield pd.DataFrame(out, columns=["i", "concepto"])

    kind = dict(texts.dtypes)[id_col]
    return texts.select(F.col(id_col).alias("i"), F.col(text).alias("t")).mapInPandas(find, f"i {kind}, concepto string").distinct().withColumnRenamed("i", id_col)


def measurement(c: str) -> Column:
    return known(F.col(c))


def refine_order(steps: DataFrame, style: str = "smooth", rounds: int = 8, gain: float = 0.01) -> DataFrame:
    """(lista_id, pista_id, posicion): neighbours are swapped while that raises the sum of the transition into the pair and the one inside it by more than ``gain``.

    ``steps``: lista_id, posicion, pista_id, bpm, clave, energy; a session is a planned list, so it is bounded by POOL rows and
    fits a task. The first track stays.
    """
    wb, wk, we = STYLES.get(style, (0.40, 0.30, 0.30))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("posicion").to_dict("records")

        def tempo(a, b):
            if not (a and b and a > 0 and b > 0):
                return NEUTRAL
            d = min(abs(a - b), abs(a * 2 - b), abs(a / 2 - b))
            return 1.0 if d <= BPM_NEAR else 1 - 0.5 * (d - BPM_NEAR) / BPM_NEAR if d <= 2 * BPM_NEAR else 0.5 - 0.5 * (d - 2 * BPM_NEAR) / (BPM_FAR - 2 * BPM_NEAR) if d <= BPM_FAR else 0.0

        def key(a, b):
            if not (a and b):
                return 0.5
            d = abs(int(a[:-1]) - int(b[:-1]))
            d, same = min(d, 12 - d), a[-1] == b[-1]
            return 1.0 if d == 0 and same else 0.85 if d == 0 or d == 1 and same else 0.6 if d == 2 and same else 0.3

        def energy(a, b):
            if a is None or b is None or a != a or b != b:
                return NEUTRAL
            d = abs(a - b)
            return 1.0 if d <= 0.1 else 1 - (d - 0.1) / 0.3 if d <= 0.25 else max(0.0, 0.5 - (d - 0.25) * 2)

        def score(x, y):
            return wb * tempo(x["bpm"], y["bpm"]) + wk * key(x["clave"], y["clave"]) + we * energy(x["energy"], y["energy"])

        for _ in range(rounds):
            moved = False
            for i in range(1, len(rows) - 2):
                p, a, b = rows[i - 1 : i + 2]
                if score(p, b) + score(b, a) > score(p, a) + score(a, b) + gain:
                    rows[i], rows[i + 1] = b, a
                    moved = True
            if not moved:
                break
        return pd.DataFrame({"lista_id": [r["lista_id"] for r in rows], "pista_id": [r["pista_id"] for r in rows], "posicion": range(1, len(rows) + 1)})

    return steps.filter(F.col("posicion") <= POOL).groupBy("lista_id").applyInPandas(run, "lista_id long, pista_id long, posicion long")


def speed_class(factor: Column) -> Column:
    """Whether a machine is fast enough, by its real-time factor."""
    return F.when(factor <= 1.5, "alto").when(factor <= 5, "medio").otherwise("bajo")


def volumes(technique: Column, progress: Column) -> Column:
    """struct(sale, entra): the volumes of the outgoing and the incoming track as a transition advances from 0 to 1."""
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), progress))
    out = F.when(technique == "hard_cut", F.when(p < 0.5, 1.0).otherwise(0.0)).when(technique == "energy_blend", F.sqrt(1 - p)).when(technique == "harmonic_mix", F.greatest(F.lit(0.0), 1 - p * 0.6)).otherwise(1 - p)
    come = F.when(technique == "hard_cut", F.when(p < 0.5, 0.0).otherwise(1.0)).when(technique == "energy_blend", F.sqrt(p)).when(technique == "harmonic_mix", F.least(F.lit(1.0), 0.4 + p * 0.6)).otherwise(p)
    return F.struct(out.alias("sale"), come.alias("entra"))


def session_log(events: DataFrame, who: str, props: str, session: int | None = None) -> DataFrame:
    """(who, event_id, k, ts): events with their JSON parsed; of one session in order if ``session`` names it."""
    rows = events if session is None else events.filter(F.col(who) == session)
    out = rows.select(who, "event_id", F.from_json(props, "k int")["k"].alias("k"), "ts")
    return out if session is None else out.orderBy("ts", "event_id")
