"""Ranked text search over tracks, albums and artists: a ladder of matches, in one scan."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence

import pandas as pd
from difflib import SequenceMatcher
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tonalis.functions.text import STOP_WORDS, compare_form
from tonalis.operators.library import in_library

FUZZY_WORD, FUZZY_TEXT = 0.82, 0.80
#: What a track gets if its words begin with all that were asked, or if a field holds the text as it stands.
PREFIX_BONUS, INSIDE_BONUS = 500.0, 250.0
#: Weights of the fields (title, artist, album, genre) in BM25, and its parameters.
FIELD_WEIGHTS, K1, B = (4.0, 2.2, 1.6, 0.4), 1.2, 0.75
FIELDS = ("titulo", "artista_nombre", "album_titulo", "genero")


class Question:
    """A search text in comparison form with its useful words."""

    def __init__(self, text: str) -> None:
        import re
        import unicodedata

        folded = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
        self.form = " ".join(re.sub(r"[^\w\s]", " ", folded).split())
        self.raw = text.strip().lower()
        every = self.form.split()
        self.every = every
        self.words = [w for w in every if w not in STOP_WORDS] or every
        self.fuzzy = len(self.form) >= 4


def has(text: Column, part: str) -> Column:
    return F.contains(text, F.lit(part))


def prefix_match(text: Column, words: Sequence[str]) -> Column:
    """Every word begins a token of the text."""
    out = F.lit(True)
    for w in words:
        out &= F.contains(F.concat(F.lit(" "), text), F.lit(" " + w))
    return out


def coverage(text: Column, words: Sequence[str]) -> Column:
    """The share of the words that the text holds."""
    if not words:
        return F.lit(0.0)
    return sum((has(text, w).cast("int") for w in words), F.lit(0)) / len(words)


def bounded_ratio(ask: str, text: str, least: float, letters: dict[str, int] | None = None) -> float:
    """The sequence ratio if it reaches ``least``, else 0. Lengths, then the letters that both have, bound it from above and cost little."""
    whole = len(ask) + len(text)
    if not whole or 2 * min(len(ask), len(text)) < least * whole:
        return 0.0
    letters = Counter(ask) if letters is None else letters
    if 2 * sum(min(n, text.count(c)) for c, n in letters.items()) < least * whole:
        return 0.0
    r = SequenceMatcher(None, ask, text).ratio()
    return r if r >= least else 0.0


def fuzzy_coverage(words: Sequence[str]):
    """The same, where a word of four letters or more also counts if a token is close to it (Arrow UDF, each different token once)."""

    @F.pandas_udf(DoubleType())
    def share(text: pd.Series) -> pd.Series:
        near: dict[tuple[str, str], bool] = {}

        def close(w: str, x: str) -> bool:
            if (w, x) not in near:
                if len(near) > 500_000:
                    near.clear()
                near[w, x] = bounded_ratio(w, x, FUZZY_WORD) > 0
            return near[w, x]

        def one(t: str) -> float:
            tokens = t.split()
            hit = sum(w in t or len(w) >= 4 and any(close(w, x) for x in tokens) for w in words)
            return hit / len(words) if t and words else 0.0

        return text.map(one)

    return share


def close_ratio(ask: str, least: float):
    """The sequence ratio of a text and ``ask`` where it reaches ``least``, else 0 (Arrow UDF)."""

    @F.pandas_udf(DoubleType())
    def ratio(text: pd.Series) -> pd.Series:
        letters = Counter(ask)
        return text.map(lambda t: bounded_ratio(ask, t or "", least, letters)).astype(float)

    return ratio


def text_score(q: Question, main: Column, others: Sequence[Column], fuzzy: bool = False) -> Column:
    """The best rung of the ladder that the main text or one of the others reaches; 0 without a match."""
    zero = F.lit(0.0)
    rungs = [F.when(main == q.form, 10000.0).when(main.startswith(q.form), 9000.0).when(has(main, q.form), 8000.0).otherwise(zero)]
    rungs += [F.when(o == q.form, 7600.0).when(o.startswith(q.form), 7000.0).when(has(o, q.form), 6400.0).otherwise(zero) for o in others]
    full = F.trim(F.concat_ws(" ", main, *others))
    share = fuzzy_coverage(q.words) if fuzzy else (lambda t: coverage(t, q.words))
    own, total = share(main), share(full)
    many = len(q.words) >= 2
    ladder = F.when(own >= 0.999, 7800.0).when(total >= 0.999, 7200.0)
    if many:
        ladder = ladder.when(total >= 0.67, 5600.0 + total * 600.0).when(own > 0, 3800.0 + own * 500.0)
    rungs.append(ladder.otherwise(zero))
    if fuzzy and q.fuzzy:
        close = close_ratio(q.form, FUZZY_TEXT)
        r = F.greatest(close(main), close(full))
        rungs.append(F.when(r >= 0.88, 5200.0 + r * 1000.0).when((r >= FUZZY_TEXT) & (total >= 0.5), 4300.0 + r * 700.0).otherwise(zero))
    return F.greatest(*rungs)


def with_forms(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The comparison form of each column as ``_f_*``, computed once."""
    return df.withColumns({f"_f_{c}": compare_form(F.col(c).cast("string")) for c in columns})


def best_matches(scored: DataFrame, name: str, limit: int) -> DataFrame:
    """The best rows with a score above 0. The condition follows the limit: before it, the score would be computed twice."""
    return scored.orderBy(F.desc("puntaje"), name, "id").limit(limit).filter("puntaje > 0")


def search_tracks(tracks: DataFrame, text: str, limit: int = 20, fuzzy: bool = False) -> DataFrame:
    """(id, titulo, artista_nombre, puntaje): library tracks that match, best first; plays only break ties between matches.

    On top of the ladder come PREFIX_BONUS where every word begins a word of title, artist, album or genre, else INSIDE_BONUS where one
    of these holds the text as it stands.
    """
    q = Question(text)
    t = with_forms(in_library(tracks), ["titulo", "artista_nombre", "album_titulo", "genero", "anio"])
    title, artist, album = F.col("_f_titulo"), F.col("_f_artista_nombre"), F.col("_f_album_titulo")
    score = text_score(q, title, [artist, album, F.col("_f_genero"), F.col("_f_anio")], fuzzy)
    catalogue = F.concat_ws(" ", *[F.nullif(F.col(f"_f_{c}"), F.lit("")) for c in ("titulo", "artista_nombre", "album_titulo", "genero", "anio")])
    every = F.lit(bool(q.words))
    for w in q.words:
        every &= has(catalogue, w)
    inside = lambda c: (c != "") & F.contains(F.lit(q.form), c)
    asked = " ".join(q.words)
    both = (title != "") & (artist != "") & (F.concat_ws(" ", title, artist).startswith(asked) | F.concat_ws(" ", artist, title).startswith(asked))
    score = F.greatest(
        score, F.when(every, 6200.0 + min(900.0, len(q.words) * 160.0)).otherwise(0.0), F.when(inside(title) & inside(artist), 9500.0).otherwise(0.0),
        F.when(inside(title) & inside(album), 9000.0).otherwise(0.0), F.when(both, 8800.0).otherwise(0.0),
    )
    words = F.concat_ws(" ", *[F.col(f"_f_{c}") for c in FIELDS])
    inside_field = F.lit(False)
    for c in FIELDS:
        inside_field |= F.coalesce(has(F.lower(c), q.raw), F.lit(False))
    bonus = F.when(prefix_match(words, q.every) & F.lit(bool(q.every)), PREFIX_BONUS).when(inside_field & F.lit(bool(q.raw)), INSIDE_BONUS).otherwise(0.0)
    popular = F.when(F.col("_s") > 0, F.col("_s") + F.least(F.lit(250.0), F.coalesce("veces_reproducida", F.lit(0)) * 10.0)).otherwise(0.0)
    s = t.withColumn("_s", score).select("id", "titulo", "artista_nombre", F.round(popular + bonus, 4).alias("puntaje"))
    return best_matches(s, "titulo", limit)


def search_albums(albums: DataFrame, artists: DataFrame, text: str, limit: int = 10, fuzzy: bool = False) -> DataFrame:
    q = Question(text)
    a = with_forms(albums.join(artists.select(F.col("id").alias("artista_id"), F.col("nombre").alias("artista")), "artista_id").select("id", "titulo", "artista"), ["titulo", "artista"])
    s = text_score(q, F.col("_f_titulo"), [F.col("_f_artista")], fuzzy)
    return best_matches(a.select("id", "titulo", "artista", F.round(s, 4).alias("puntaje")), "titulo", limit)


def search_artists(artists: DataFrame, text: str, limit: int = 10, fuzzy: bool = False) -> DataFrame:
    q = Question(text)
    a = with_forms(artists.select("id", "nombre"), ["nombre"])
    return best_matches(a.select("id", "nombre", F.round(text_score(q, F.col("_f_nombre"), [], fuzzy), 4).alias("puntaje")), "nombre", limit)


def search_bm25(tracks: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """(id, titulo, puntaje): library tracks whose words begin with every word asked, by BM25 over the weighted fields, best first.

    A word asked counts as often as words of a field begin with it, times the field's weight. The counts of the whole library (rows,
    words, rows with each word asked) are one row of an aggregate; the ranking is a second scan.
    """
    asked = list(dict.fromkeys(Question(text).every))
    t = with_forms(in_library(tracks), FIELDS)
    words = [F.filter(F.split(F.col(f"_f_{c}"), " "), lambda w: w != "") for c in FIELDS]
    rows = t.withColumns({f"_w{k}": w for k, w in enumerate(words)})
    begun = lambda a: [F.size(F.filter(F.col(f"_w{k}"), lambda w: w.startswith(a))) for k in range(len(FIELDS))]
    length = sum((F.size(F.col(f"_w{k}")) for k in range(len(FIELDS))), F.lit(0))
    rows = rows.select("id", "titulo", length.alias("_len"), *[sum((n * w for n, w in zip(begun(a), FIELD_WEIGHTS)), F.lit(0.0)).alias(f"_q{k}") for k, a in enumerate(asked)])
    if not asked:
        return rows.select("id", "titulo", F.lit(0.0).alias("puntaje")).limit(0)
    whole = rows.agg(F.count("*").alias("n"), F.avg("_len").alias("mean"), *[F.count_if(F.col(f"_q{k}") > 0).alias(f"n{k}") for k in range(len(asked))]).first()
    score, every = F.lit(0.0), F.lit(True)
    for k in range(len(asked)):
        idf = max(1e-6, math.log((whole.n - whole[f"n{k}"] + 0.5) / (whole[f"n{k}"] + 0.5)))
        f = F.col(f"_q{k}")
        score += idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_len") / (whole.mean or 1.0)))
        every &= f > 0
    return rows.filter(every).select("id", "titulo", F.round(score, 6).alias("puntaje")).orderBy(F.desc("puntaje"), "titulo", "id").limit(limit)


def token_index(tracks: DataFrame) -> DataFrame:
    """(token, id, campo, veces): every word of the four fields of each library track, a table to write once and join with."""
    t = with_forms(in_library(tracks), FIELDS)
    one = F.array(*[F.struct(F.lit(c).alias("campo"), F.split(F.col(f"_f_{c}"), " ").alias("w")) for c in FIELDS])
    words = t.select("id", F.explode(one).alias("f")).select("id", "f.campo", F.explode("f.w").alias("token")).filter("token <> ''")
    return words.groupBy("token", "id", "campo").agg(F.count("*").alias("veces"))


def match_tokens(index: DataFrame, text: str) -> DataFrame:
    """(id, palabras): the rows of a :func:`token_index` that hold a word beginning with every word asked. The condition on ``token`` reaches the scan."""
    asked = list(dict.fromkeys(Question(text).every))
    which = F.array_compact(F.array(*[F.when(F.col("token").startswith(a), F.lit(k)) for k, a in enumerate(asked)]))
    hit = F.lit(False)
    for a in asked:
        hit |= F.col("token").startswith(a)
    found = index.filter(hit).select("id", F.explode(which).alias("k")).distinct().groupBy("id").agg(F.count("*").cast("int").alias("palabras"))
    return found.filter(F.col("palabras") == len(asked))


def universal(tracks: DataFrame, albums: DataFrame, artists: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """(clase, id, nombre, puntaje): the best tracks, ten albums and ten artists of the library for one text."""
    own = in_library(tracks)
    a = albums.join(own.select(F.col("album_id").alias("id")).filter("id is not null").distinct(), "id", "left_semi")
    r = artists.join(own.select(F.col("artista_id").alias("id")).filter("id is not null").distinct(), "id", "left_semi")
    parts = {"pista": search_tracks(tracks, text, limit).select("id", F.col("titulo").alias("nombre"), "puntaje"), "album": search_albums(a, artists, text).select("id", F.col("titulo").alias("nombre"), "puntaje"), "artista": search_artists(r, text)}
    out = None
    for name, df in parts.items():
        one = df.select(F.lit(name).alias("clase"), "id", "nombre", "puntaje")
        out = one if out is None else out.unionByName(one)
    return out
