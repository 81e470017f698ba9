"""Ranked search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonalis.functions.text import compare_form
from tonalis.operators import search as X
from tonalis.plans.registry import Registry
from tonalis.plans.text import cmp_sql
from tonalis.tables import Tables

query = Registry()

_TEXT, _ALBUM, _ARTIST = "canción de mar", "saudade", "roberto"


def _cover(text: str, words: list[str]) -> str:
    return "((" + " + ".join(f"contains({text}, '{w}')::INT" for w in words) + f") / {len(words)}.0::DOUBLE)"


def score_sql(q: X.Question, main: str, others: list[str]) -> str:
    full = "trim(concat_ws(' ', " + ", ".join([main, *others]) + "))"
    own, total = _cover(main, q.words), _cover(full, q.words)
    rungs = [f"CASE WHEN {main} = '{q.form}' THEN 10000.0 WHEN starts_with({main}, '{q.form}') THEN 9000.0 WHEN contains({main}, '{q.form}') THEN 8000.0 ELSE 0.0 END"]
    rungs += [f"CASE WHEN {o} = '{q.form}' THEN 7600.0 WHEN starts_with({o}, '{q.form}') THEN 7000.0 WHEN contains({o}, '{q.form}') THEN 6400.0 ELSE 0.0 END" for o in others]
    more = f" WHEN {total} >= 0.67 THEN 5600.0 + {total} * 600.0 WHEN {own} > 0 THEN 3800.0 + {own} * 500.0" if len(q.words) >= 2 else ""
    rungs.append(f"CASE WHEN {own} >= 0.999 THEN 7800.0 WHEN {total} >= 0.999 THEN 7200.0{more} ELSE 0.0 END")
    return "greatest(" + ", ".join(f"CAST({r} AS DOUBLE)" for r in rungs) + ")"


def tracks_sql(text: str, limit: int = 20) -> str:
    _Q = X.Question(text)
    words = "' ' || concat_ws(' ', coalesce(ft, ''), coalesce(fa, ''), coalesce(fb, ''), coalesce(fg, ''))"
    begun = " AND ".join(f"contains({words}, ' {w}')" for w in _Q.every)
    held = " OR ".join(f"coalesce(contains(lower({c}), '{_Q.raw}'), false)" for c in X.FIELDS)
    return f"""WITH f AS (SELECT *, {cmp_sql('titulo')} AS ft, {cmp_sql('artista_nombre')} AS fa, {cmp_sql('album_titulo')} AS fb, {cmp_sql('genero')} AS fg, {cmp_sql('CAST(anio AS VARCHAR)')} AS fy FROM pistas WHERE estado = 'biblioteca'),
s AS (SELECT *, greatest({score_sql(_Q, 'ft', ['fa', 'fb', 'fg', 'fy'])},
CASE WHEN {" AND ".join(f"contains(concat_ws(' ', nullif(ft, ''), nullif(fa, ''), nullif(fb, ''), nullif(fg, ''), nullif(fy, '')), '{w}')" for w in _Q.words)} THEN {6200.0 + min(900.0, len(_Q.words) * 160.0)} ELSE 0.0 END,
CASE WHEN ft <> '' AND fa <> '' AND contains('{_Q.form}', ft) AND contains('{_Q.form}', fa) THEN 9500.0 ELSE 0.0 END, CASE WHEN ft <> '' AND fb <> '' AND contains('{_Q.form}', ft) AND contains('{_Q.form}', fb) THEN 9000.0 ELSE 0.0 END,
CASE WHEN ft <> '' AND fa <> '' AND (starts_with(ft || ' ' || fa, '{" ".join(_Q.words)}') OR starts_with(fa || ' ' || ft, '{" ".join(_Q.words)}')) THEN 8800.0 ELSE 0.0 END) AS s FROM f),
x AS (SELECT *, CASE WHEN s > 0 THEN s + least(250.0, coalesce(veces_reproducida, 0) * 10.0) ELSE 0.0 END + CASE WHEN {begun} THEN 500.0 WHEN {held} THEN 250.0 ELSE 0.0 END AS t FROM s)
SELECT id, titulo, artista_nombre, round(CAST(t AS DOUBLE), 4) AS puntaje FROM x WHERE t > 0 ORDER BY puntaje DESC, titulo, id LIMIT {limit}"""


_TRACKS = tracks_sql(_TEXT)


@query(_TRACKS)
def search_tracks(t: Tables) -> DataFrame:
    """The ladder without its fuzzy rungs."""
    return X.search_tracks(t.pistas, _TEXT)


@query()
def search_tracks_fuzzy(t: Tables) -> DataFrame:
    """With the fuzzy rungs: close words and the sequence ratio; a typing error is found."""
    return X.search_tracks(t.pistas, "cansion del maar", fuzzy=True)


_QA = X.Question(_ALBUM)


@query(f"""WITH f AS (SELECT b.id, b.titulo, a.nombre AS artista, {cmp_sql('b.titulo')} AS ft, {cmp_sql('a.nombre')} AS fa FROM albums b JOIN artistas a ON a.id = b.artista_id)
SELECT id, titulo, artista, round({score_sql(_QA, 'ft', ['fa'])}, 4) AS puntaje FROM f WHERE {score_sql(_QA, 'ft', ['fa'])} > 0 ORDER BY puntaje DESC, titulo, id LIMIT 10""")
def search_albums(t: Tables) -> DataFrame:
    return X.search_albums(t.albums, t.artistas, _ALBUM)


_QR = X.Question(_ARTIST)


@query(f"""WITH f AS (SELECT id, nombre, {cmp_sql('nombre')} AS fn FROM artistas) SELECT id, nombre, round({score_sql(_QR, 'fn', [])}, 4) AS puntaje FROM f WHERE {score_sql(_QR, 'fn', [])} > 0 ORDER BY puntaje DESC, nombre, id LIMIT 10""")
def search_artists(t: Tables) -> DataFrame:
    return X.search_artists(t.artistas, _ARTIST)


@query(f"""SELECT id, titulo FROM pistas WHERE contains(' ' || {cmp_sql("titulo || ' ' || artista_nombre")}, ' mar') AND contains(' ' || {cmp_sql("titulo || ' ' || artista_nombre")}, ' jo')""")
def search_prefix(t: Tables) -> DataFrame:
    """Tracks with words that begin with each of the given prefixes."""
    text = compare_form(F.concat_ws(" ", "titulo", "artista_nombre"))
    return t.pistas.filter(X.prefix_match(text, ["mar", "jo"])).select("id", "titulo")


@query(f"""WITH s AS ({_TRACKS}) SELECT s.id, s.puntaje, EXISTS (SELECT 1 FROM score_detalle d WHERE d.sesion_id = 1 AND d.pista_id = s.id) AS presente FROM s""")
def search_picker(t: Tables) -> DataFrame:
    """Search results with a mark for those that a playlist already holds."""
    found = X.search_tracks(t.pistas, _TEXT)
    own = t.score_detalle.filter("sesion_id = 1").select(F.col("pista_id").alias("_p")).distinct()
    return found.join(own, F.col("id") == F.col("_p"), "left").select("id", "puntaje", F.col("_p").isNotNull().alias("presente"))


@query(f"""WITH d AS (SELECT doc_id, {cmp_sql('text')} AS f FROM documents) SELECT doc_id, CAST(contains(f, 'guitarra')::INT + contains(f, 'silencio')::INT + contains(f, 'orquesta')::INT AS INT) AS n FROM d WHERE contains(f, 'guitarra') OR contains(f, 'silencio') OR contains(f, 'orquesta')""")
def search_documents(t: Tables) -> DataFrame:
    """Documents by the number of search words that they hold."""
    d = t.documents.select("doc_id", compare_form(F.col("text")).alias("f"))
    n = sum((X.has(F.col("f"), w).cast("int") for w in ("guitarra", "silencio", "orquesta")), F.lit(0))
    return d.select("doc_id", n.alias("n")).filter("n > 0")


_BM = [w for w in dict.fromkeys(X.Question("la can").every)]
_BM_WORDS = ", ".join(f"list_filter(string_split({cmp_sql(c)}, ' '), lambda w: w <> '') AS w{k}" for k, c in enumerate(X.FIELDS))


def _begun(word: str) -> str:
    return " + ".join(f"len(list_filter(coalesce(w{k}, []), lambda w: starts_with(w, '{word}'))) * {weight}" for k, weight in enumerate(X.FIELD_WEIGHTS))


_BM25 = f"""WITH t AS (SELECT id, titulo, {_BM_WORDS} FROM pistas WHERE estado = 'biblioteca'),
r AS (SELECT id, titulo, {" + ".join(f"coalesce(len(w{k}), 0)" for k in range(4))} AS n, {", ".join(f"CAST({_begun(w)} AS DOUBLE) AS q{k}" for k, w in enumerate(_BM))} FROM t),
g AS (SELECT count(*) AS rows, avg(n) AS mean, {", ".join(f"count(*) FILTER (q{k} > 0) AS n{k}" for k in range(len(_BM)))} FROM r)
SELECT id, titulo, round({" + ".join(f"greatest(1e-6, ln((rows - n{k} + 0.5) / (n{k} + 0.5))) * q{k} * 2.2 / (q{k} + 1.2 * (0.25 + 0.75 * n / mean))" for k in range(len(_BM)))}, 6) AS puntaje FROM r, g
WHERE {" AND ".join(f"q{k} > 0" for k in range(len(_BM)))} ORDER BY puntaje DESC, titulo, id LIMIT 20"""


@query(_BM25)
def search_bm25(t: Tables) -> DataFrame:
    """Prefix search ranked by BM25 with weighted fields."""
    return X.search_bm25(t.pistas, "la can")


@query(f"""WITH w AS (SELECT id, unnest(string_split(concat_ws(' ', {", ".join(cmp_sql(c) for c in X.FIELDS)}), ' ')) AS w FROM pistas WHERE estado = 'biblioteca')
SELECT id, CAST(2 AS INT) AS palabras FROM w GROUP BY id HAVING bool_or(starts_with(w, 'mar')) AND bool_or(starts_with(w, 'jo'))""")
def search_match(t: Tables) -> DataFrame:
    """Full-text match through a table of words."""
    return X.match_tokens(X.token_index(t.pistas), "mar jo")


@query(f"""SELECT 'pista' AS clase, id, titulo AS nombre, puntaje FROM ({tracks_sql(_ARTIST)})
UNION ALL SELECT 'album', id, titulo, puntaje FROM (WITH f AS (SELECT b.id, b.titulo, {cmp_sql('b.titulo')} AS ft, {cmp_sql('a.nombre')} AS fa FROM albums b JOIN artistas a ON a.id = b.artista_id WHERE b.id IN (SELECT album_id FROM pistas WHERE estado = 'biblioteca'))
 SELECT id, titulo, round({score_sql(_QR, 'ft', ['fa'])}, 4) AS puntaje FROM f WHERE {score_sql(_QR, 'ft', ['fa'])} > 0 ORDER BY puntaje DESC, titulo, id LIMIT 10)
UNION ALL SELECT 'artista', id, nombre, puntaje FROM (WITH f AS (SELECT id, nombre, {cmp_sql('nombre')} AS fn FROM artistas WHERE id IN (SELECT artista_id FROM pistas WHERE estado = 'biblioteca'))
 SELECT id, nombre, round({score_sql(_QR, 'fn', [])}, 4) AS puntaje FROM f WHERE {score_sql(_QR, 'fn', [])} > 0 ORDER BY puntaje DESC, nombre, id LIMIT 10)""")
def search_universal(t: Tables) -> DataFrame:
    """Tracks, albums and artists for one text."""
    return X.universal(t.pistas, t.albums, t.artistas, _ARTIST)
