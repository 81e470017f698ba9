"""What a phrase asks for: concepts in a text, negations and degrees, the axes that follow, and how tracks fit them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonalis.functions.text import compare_form
from tonalis.functions.vectors import cosine
from tonalis.operators.features import NEUTRAL, axes_score, known

# Words that negate what follows within four words, words that end a negation, and what degrees do to a weight.
NEGATIONS = ("sin", "no", "menos", "evita", "evitar", "nada de", "without", "skip")
BREAKS = ("pero", "but", "aunque", "y", "and", "con", "with", "que")
WINDOW, REACH = 4, 12
STRONG, WEAK = 1.6, 0.55
BOOST, FOCUS_MOST, EMBEDDING_SHARE = 1.25, 0.15, 0.25
# The axis that each feature speaks of.
FEATURE_AXES = {
    "energy": "energy", "danceability_proxy": "danceability", "danceability_model": "danceability", "valence_proxy": "euphoria", "valence": "euphoria", "arousal_proxy": "energy", "arousal": "energy",
    "calmness_proxy": "calmness", "melancholy_proxy": "melancholy", "brightness": "brightness", "darkness_proxy": "darkness", "aggressiveness_proxy": "aggressiveness", "mood_aggressive": "aggressiveness",
    "mood_relaxed": "calmness", "mood_happy": "euphoria", "mood_sad": "melancholy", "mood_party": "club_energy", "focus_score_proxy": "focus_score", "workout_score_proxy": "workout_score",
    "party_score_proxy": "club_energy", "night_score_proxy": "night_score",
}
AXES = tuple(dict.fromkeys(FEATURE_AXES.values()))


@dataclass(frozen=True)
class Concept:
    """An idea that a phrase may name: in comparison form its aliases; what it asks of each axis; its weight among others."""

    name: str
    aliases: tuple[str, ...]
    axes: Mapping[str, float]
    weight: float = 1.0
    role: str = "normal"  # or priority, exclusion, strong, weak
    genres: tuple[str, ...] = ()
    boosts: tuple[str, ...] = ()
    opposites: tuple[str, ...] = ()


@dataclass(frozen=True)
class Intent:
    """What a phrase asks for; ``vector`` holds the axes of its concepts, then their weights, whatever is negated."""

    axes: dict[str, float]
    focus: list[str]
    excluded: list[str]
    genres: dict[str, float]
    excluded_genres: list[str]
    contradictions: list[str]
    vector: list[float]


def find(text: str, concepts: Sequence[Concept]) -> list[tuple[int, int, Concept]]:
    """(from, to, concept) in order: aliases that stand as whole words, the longest first, none over another."""
    padded, taken, out = f" {text} ", [], []
    for alias, c in sorted(((a, c) for c in concepts for a in c.aliases), key=lambda x: (-len(x[0]), x[0])):
        at = padded.find(f" {alias} ")
        while at >= 0:
            begin, end = at, at + len(alias)
            if all(end <= b or begin >= e for b, e in taken):
                taken.append((begin, end))
                out.append((begin, end, c))
            at = padded.find(f" {alias} ", at + 1)
    return sorted(out, key=lambda x: x[0])


def _negated(before: str) -> bool:
    window = f" {' '.join(before.split()[-WINDOW:])} "
    last = max(window.rfind(f" {n} ") for n in NEGATIONS)
    return last >= 0 and not any(f" {b} " in window[last + 1 :] for b in BREAKS)


def _votes(matches: Iterable[tuple[Concept, float]]) -> dict[str, float]:
    out: dict[str, float] = {}
    for c, factor in matches:
        for axis, delta in c.axes.items():
            out[axis] = out.get(axis, 0.0) + delta * c.weight * factor
    return out


def parse(text: str, concepts: Sequence[Concept]) -> Intent:
    """The intent of a phrase in comparison form.

    A degree ("muy", "un poco") right before a concept scales it; a negation within WINDOW words before it takes its axes away, unless a word of
    BREAKS comes between. Of two opposites the heavier one stays, of equal ones the later. Concepts that support each other raise the axes they share.
    """
    found = find(text, concepts)
    yes: list[tuple[Concept, float]] = []
    no: list[tuple[Concept, float]] = []
    degree, behind = None, 0
    for begin, end, c in found:
        before = text[behind:begin]
        behind = end
        if c.role in ("strong", "weak"):
            degree = STRONG if c.role == "strong" else WEAK
            continue
        factor = degree if degree is not None and len(before.strip()) <= REACH else 1.0
        degree = None
        (no if c.role != "exclusion" and _negated(before) else yes).append((c, factor))
    clashes: list[str] = []
    for a, b in sorted({tuple(sorted((c.name, o))) for c, _ in yes for o in c.opposites if any(d.name == o for d, _ in yes)}):
        clashes.append(f"{a}|{b}")
        one, two = ([k for k, (c, _) in enumerate(yes) if c.name == n] for n in (a, b))
        if one and two:
            wa, wb = yes[one[0]][0].weight, yes[two[0]][0].weight
            loser = b if wa > wb or wa == wb and one[0] > two[0] else a
            yes = [x for x in yes if x[0].name != loser]
    axes = _votes(yes)
    for axis, v in _votes(no).items():
        axes[axis] = axes.get(axis, 0.0) - v
    here = {c.name: c for c, _ in yes}
    for c, _ in yes:
        for other in c.boosts:
            if other in here:
                for axis in c.axes:
                    if axis in here[other].axes and axis in axes:
                        axes[axis] *= BOOST
    genres: dict[str, float] = {}
    for c, _ in yes:
        for g in c.genres if c.role != "exclusion" else ():
            genres[g] = genres.get(g, 0.0) + c.weight / len(c.genres)
    named = [c for _, _, c in found]
    every = _votes((c, 1.0) for c in named)
    weights = {c.name: c.weight for c in named}
    return Intent(
        axes, [c.name for c, _ in yes if c.role == "priority"], list(dict.fromkeys([c.name for c, _ in no] + [c.name for c, _ in yes if c.role == "exclusion"])), genres,
        list(dict.fromkeys(g for c, _ in no for g in c.genres)), clashes, [every.get(a, 0.0) for a in AXES] + [weights.get(c.name, 0.0) for c in concepts],
    )


def intents(texts: DataFrame, concepts: Sequence[Concept], id_col: str, text: str) -> DataFrame:
    """(id, ejes, focos, excluidos, generos, generos_excluidos, contradicciones, vector) of each text in comparison form.

    ``concepts`` is a table of the program, sent with the function. A null or empty text asks for nothing.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, t in zip(b["i"].tolist(), b["t"]):
                x = parse(t or "", concepts)
                out.append((i, x.axes, x.focus, x.excluded, x.genres, x.excluded_genres, x.contradictions, x.vector))
            yield pd.DataFrame(out, columns=["i", "ejes", "focos", "excluidos", "generos", "generos_excluidos", "contradicciones", "vector"])

    kind = dict(texts.dtypes)[id_col]
    schema = f"i {kind}, ejes map<string,double>, focos array<string>, excluidos array<string>, generos map<string,double>, generos_excluidos array<string>, contradicciones array<string>, vector array<double>"
    return texts.select(F.col(id_col).alias("i"), F.col(text).alias("t")).mapInPandas(run, schema).withColumnRenamed("i", id_col)


def _named(text: Column, c: Concept) -> Column:
    """Whether a text in comparison form names the concept."""
    out = F.lit(False)
    for a in c.aliases:
        out |= F.contains(F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" ")), F.lit(f" {a} "))
    return out


def _counter(c: Concept):
    return lambda n, x: n + _named(x, c).cast("int")


def track_vector(concepts: Sequence[Concept]) -> Column:
    """The embedding of a track, in the space of :attr:`Intent.vector`: its features on the axes from -1 to 1, its genre, tags and title on the concepts."""
    tagged = {c.name: F.aggregate(F.coalesce(F.col("vibe_tags"), F.array().cast("array<string>")), F.lit(0), _counter(c)) for c in concepts}
    title = compare_form(F.concat_ws(" ", "titulo", "artista_nombre"))
    axes = []
    for a in AXES:
        v = sum((F.coalesce((known(F.col(f)) - 0.5) * 2.0, F.lit(0.0)) for f, x in FEATURE_AXES.items() if x == a), F.lit(0.0))
        axes.append(v + sum((tagged[c.name] * (c.axes[a] * 0.5) for c in concepts if a in c.axes), F.lit(0.0)))
    own = []
    for c in concepts:
        genre = F.when(F.lower(F.trim("genero")).isin(*c.genres), 1.0).otherwise(0.0) if c.genres else F.lit(0.0)
        own.append(genre + tagged[c.name] * c.weight + F.when(_named(title, c), c.weight * 0.5).otherwise(0.0))
    return F.array(*axes, *own)


def track_score(intent: Intent, concepts: Sequence[Concept], values: str = "valores") -> Column:
    """Three quarters how the axes of a track fit, with a bonus of at most FOCUS_MOST for each focus that it shows, and a quarter the cosine of the embeddings."""
    part = lambda a: (F.coalesce(known(F.element_at(F.col(values), F.lit(a))), F.lit(NEUTRAL)) - 0.5) * 2.0
    fit = axes_score(F.col(values), intent.axes) if intent.axes else F.lit(0.0)
    for c in concepts:
        if c.name in intent.focus and c.axes:
            shown = sum((part(a) * d for a, d in c.axes.items()), F.lit(0.0))
            fit += F.when(shown > 0, F.least(F.lit(FOCUS_MOST), shown / len(c.axes))).otherwise(0.0)
    asked = F.array(*[F.lit(float(v)) for v in intent.vector])
    return (1 - EMBEDDING_SHARE) * fit + EMBEDDING_SHARE * cosine(asked, track_vector(concepts))


def without_excluded(scored: DataFrame, intent: Intent, concepts: Sequence[Concept], score: str = "puntaje") -> DataFrame:
    """Without tracks of an excluded genre; the score is halved for each excluded concept that the tags name."""
    table = {c.name: c for c in concepts}
    genres = sorted({g.lower() for g in intent.excluded_genres} | {g.lower() for n in intent.excluded for g in table[n].genres})
    out = scored.filter(~F.coalesce(F.lower("genero").isin(*genres), F.lit(False))) if genres else scored
    for n in intent.excluded:
        tags = F.transform(F.coalesce(F.col("vibe_tags"), F.array().cast("array<string>")), lambda x: F.lower(x))
        out = out.withColumn(score, F.when(F.arrays_overlap(tags, F.array(*[F.lit(a) for a in table[n].aliases])), F.col(score) * 0.5).otherwise(F.col(score)))
    return out


def rejected_items(log: DataFrame, item: str, kind: str, kinds: Sequence[str]) -> DataFrame:
    """(item): what a log of events says to leave out, each once."""
    return log.filter(F.col(kind).isin(*kinds) & F.col(item).isNotNull()).select(item).distinct()


def pool(tracks: DataFrame, features: DataFrame, axes: DataFrame, left_out: DataFrame, most: int = 5000) -> DataFrame:
    """Library tracks with their features and axes, without those left out, at most ``most`` by id: what a session chooses from.

    ``tracks`` and ``features`` have id, ``axes`` pista_id and valores, ``left_out`` id.
    """
    own = tracks.filter("estado = 'biblioteca'").select("id", "titulo").join(left_out, "id", "left_anti")
    a = axes.select(F.col("pista_id").alias("id"), "valores")
    return own.join(features, "id", "left").join(a, "id", "left").orderBy("id").limit(most)
