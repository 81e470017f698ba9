"""Text functions over the library's titles, names, paths and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonalis.functions import text as X
from tonalis.plans.registry import Registry
from tonalis.tables import Tables

query = Registry()


def cmp_sql(x: str) -> str:
    """The comparison form in SQL."""
    return rf"trim(regexp_replace(regexp_replace(translate(strip_accents(lower(coalesce({x}, ''))), 'ªº', 'ao'), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '[\s\p{{Z}}]+', ' ', 'g'))"


def collapse_sql(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[\s\p{{Z}}]+', ' ', 'g'))"


def tokens_sql(x: str) -> str:
    return f"list_distinct(list_filter(string_split({cmp_sql(x)}, ' '), lambda t: t <> ''))"


@query(f"SELECT id, {cmp_sql('titulo')} AS titulo, {cmp_sql('artista_nombre')} AS artista FROM pistas")
def text_compare_form(t: Tables) -> DataFrame:
    return t.pistas.select("id", X.compare_form(F.col("titulo")).alias("titulo"), X.compare_form(F.col("artista_nombre")).alias("artista"))


@query(r"SELECT id, lower(trim(regexp_replace(regexp_replace(strip_accents(titulo), '[^\p{L}\p{N}_\s]', ' ', 'g'), '[\s\p{Z}]+', ' ', 'g'))) AS titulo FROM pistas")
def text_canonical(t: Tables) -> DataFrame:
    return t.pistas.select("id", X.canonical(F.col("titulo")).alias("titulo"))


@query("SELECT id, strip_accents(titulo) AS titulo, strip_accents(artista_nombre) AS artista FROM pistas")
def text_fold_accents(t: Tables) -> DataFrame:
    return t.pistas.select("id", X.fold_accents(F.col("titulo")).alias("titulo"), X.fold_accents(F.col("artista_nombre")).alias("artista"))


@query()
def text_fold_exact(t: Tables) -> DataFrame:
    """Full compatibility decomposition: an Arrow UDF, no SQL states it."""
    return t.documents.select("doc_id", X.fold_exact("text").alias("texto"))


@query(rf"SELECT doc_id, md5({collapse_sql(chr(39).join(['regexp_replace(text, ', chr(92) + 'p{Cc}', ', ', '', ', ', 'g', ')']))}) AS limpio FROM documents")
def text_clean(t: Tables) -> DataFrame:
    """Control characters dropped and white space collapsed, as a digest."""
    return t.documents.select("doc_id", F.md5(X.clean(F.col("text"))).alias("limpio"))


_SITES_SQL = X.SITES.replace("'", "''")


def sites_sql(x: str) -> str:
    known = rf"regexp_replace({x}, '[\[\(]?\s*(?:www\.)?(?:{_SITES_SQL})\s*[\]\)]?', ' ', 'gi')"
    return collapse_sql(rf"regexp_replace({known}, '[\[\(]\s*(?:www\.)?[\w\-]+\.(?:org|com|cc|io|net|me)\s*[\]\)]', ' ', 'gi')")


@query(f"SELECT id, {sites_sql(chr(39).join(['titulo || ', ' [www.spotdown.org] ', ' || album_titulo || ', ' (descargas.net)', '']))} AS limpio FROM pistas")
def text_download_marks(t: Tables) -> DataFrame:
    """Download marks, here put around the titles, are dropped again."""
    dirty = F.concat("titulo", F.lit(" [www.spotdown.org] "), "album_titulo", F.lit(" (descargas.net)"))
    return t.pistas.select("id", X.drop_site_marks(dirty).alias("limpio"))


_SLUG = r"regexp_replace(substr(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}\p{{M}}]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 80), '_+$', '')"


@query("SELECT id, coalesce(nullif(" + _SLUG.format("titulo") + ", ''), 'sin_titulo') AS titulo_slug, coalesce(nullif(" + _SLUG.format("ruta_archivo") + ", ''), 'sin_titulo') AS ruta_slug FROM pistas")
def text_slug(t: Tables) -> DataFrame:
    return t.pistas.select("id", X.slug(F.col("titulo")).alias("titulo_slug"), X.slug(F.col("ruta_archivo")).alias("ruta_slug"))


_PROMO_SQL = "|".join(X._escape(p) for p in sorted(X.PROMO, key=len, reverse=True)) + r"|\(20(?:1[1-9]|2[0-5]) remaster\)|\([2345][05]th anniversary\)"


@query(f"SELECT id, {collapse_sql('regexp_replace(trim(regexp_replace(' + sites_sql('titulo') + chr(44) + chr(39) + '(?:' + _PROMO_SQL + ').*$' + chr(39) + chr(44) + chr(39) + chr(39) + chr(44) + chr(39) + 'i' + chr(39) + '))' + chr(44) + chr(39) + r'\(\s*\)|\[\s*\]' + chr(39) + chr(44) + chr(39) + chr(39) + chr(44) + chr(39) + 'g' + chr(39) + ')')} AS titulo FROM pistas")
def text_clean_title(t: Tables) -> DataFrame:
    return t.pistas.select("id", X.clean_title(F.col("titulo")).alias("titulo"))


_VERSION = "|".join(sorted(X.VERSION_WORDS, key=len, reverse=True))


@query(rf"SELECT id, coalesce(nullif(trim(regexp_replace(titulo, '\s*[\(\[]\s*(?:{_VERSION})[^\)\]]*[\)\]]', '', 'gi')), ''), titulo) AS titulo FROM pistas")
def text_strip_version(t: Tables) -> DataFrame:
    return t.pistas.select("id", X.strip_version(F.col("titulo")).alias("titulo"))


_GUEST = "titulo || ' (feat. ' || artista_nombre || ')'"


@query(rf"""WITH x AS (SELECT id, artista_nombre || ' ft. ' || coalesce(genero, 'Otro') AS a, {_GUEST} AS g FROM pistas)
SELECT id, rtrim(trim(regexp_extract(a, '(?i)^(.*?)\s*[\(\[]?\s*(?:featuring|feat\.?|ft\.?|with|w/)\s+(.*)$', 1)), '([ ') AS principal,
rtrim(trim(regexp_extract(a, '(?i)^(.*?)\s*[\(\[]?\s*(?:featuring|feat\.?|ft\.?|with|w/)\s+(.*)$', 2)), '])') AS invitados,
CASE WHEN regexp_matches(g, '(?i)[\(\[]\s*(?:featuring|feat\.?|ft\.?|with)\s+([^\)\]]+)[\)\]]') THEN trim(regexp_extract(g, '(?i)[\(\[]\s*(?:featuring|feat\.?|ft\.?|with)\s+([^\)\]]+)[\)\]]', 1)) END AS del_titulo FROM x""")
def text_featuring(t: Tables) -> DataFrame:
    """Main artist and guests, from the artist's text and from the title."""
    a = F.concat("artista_nombre", F.lit(" ft. "), F.coalesce("genero", F.lit("Otro")))
    g = F.concat("titulo", F.lit(" (feat. "), "artista_nombre", F.lit(")"))
    return t.pistas.select("id", X.main_artist(a).alias("principal"), X.featuring(a).alias("invitados"), X.title_featuring(g).alias("del_titulo"))


_BASE = collapse_sql("regexp_replace(" + sites_sql(r"trim(replace(regexp_replace(nombre_archivo, '\.[a-zA-Z0-9]{2,5}$', ''), '_', ' '))") + r", '\s*\[.*?\]\s*', ' ', 'g')")


@query(rf"""WITH b AS (SELECT id, {_BASE} AS b FROM pistas),
k AS (SELECT id, b, regexp_matches(b, '^(.+?)\s*-\s*(\d{{2}})\s*[-_.]\s*(.+)$') AS is3,
  regexp_matches(b, '^(.+?)\s*-\s*(.+)$') AND NOT regexp_matches(trim(regexp_extract(b, '^(.+?)\s*-\s*(.+)$', 1)), '^\d+$') AS is2,
  regexp_matches(b, '^(\d{{1,3}})[.\-\s_]+(.+)$') AND try_cast(regexp_extract(b, '^(\d{{1,3}})[.\-\s_]+(.+)$', 1) AS INT) BETWEEN 1 AND 99 AS is1 FROM b)
SELECT id, nullif({collapse_sql(r"CASE WHEN is3 THEN regexp_extract(b, '^(.+?)\s*-\s*(\d{2})\s*[-_.]\s*(.+)$', 1) WHEN is2 THEN regexp_extract(b, '^(.+?)\s*-\s*(.+)$', 1) END")}, '') AS artista,
nullif({collapse_sql(r"CASE WHEN is3 THEN regexp_extract(b, '^(.+?)\s*-\s*(\d{2})\s*[-_.]\s*(.+)$', 2) WHEN is2 THEN NULL WHEN is1 THEN regexp_extract(b, '^(\d{1,3})[.\-\s_]+(.+)$', 1) END")}, '') AS pista,
nullif({collapse_sql(r"CASE WHEN is3 THEN regexp_extract(b, '^(.+?)\s*-\s*(\d{2})\s*[-_.]\s*(.+)$', 3) WHEN is2 THEN regexp_extract(b, '^(.+?)\s*-\s*(.+)$', 2) WHEN is1 THEN regexp_extract(b, '^(\d{1,3})[.\-\s_]+(.+)$', 2) ELSE b END")}, '') AS titulo FROM k""")
def text_file_names(t: Tables) -> DataFrame:
    """Artist, track number and title read from file names."""
    return t.pistas.select("id", X.parse_file_name(F.col("nombre_archivo")).alias("p")).select("id", "p.artista", "p.pista", "p.titulo")


def jaccard_sql(x: str, y: str) -> str:
    return f"CASE WHEN len({x}) = 0 OR len({y}) = 0 THEN 0.0 ELSE len(list_intersect({x}, {y})) / len(list_distinct(list_concat({x}, {y}))) END"


@query(f"WITH x AS (SELECT id, {tokens_sql('titulo')} AS a, {tokens_sql('album_titulo')} AS b FROM pistas) SELECT id, round({jaccard_sql('a', 'b')}, 6) AS tokens FROM x")
def text_token_jaccard(t: Tables) -> DataFrame:
    return t.pistas.select("id", F.round(X.token_jaccard(F.col("titulo"), F.col("album_titulo")), 6).alias("tokens"))


_TRI = "list_distinct(list_transform(range(1, greatest(length({0}) - 1, 1)), lambda k: substr({0}, k, 3)))"


@query(f"""WITH x AS (SELECT id, {cmp_sql('titulo')} AS a, {cmp_sql('artista_nombre')} AS b FROM pistas WHERE length({cmp_sql('titulo')}) >= 3 AND length({cmp_sql('artista_nombre')}) >= 3),
y AS (SELECT id, {_TRI.format('a')} AS a, {_TRI.format('b')} AS b FROM x) SELECT id, round({jaccard_sql('a', 'b')}, 6) AS trigramas FROM y""")
def text_trigrams(t: Tables) -> DataFrame:
    a, b = X.trigrams(F.col("titulo")), X.trigrams(F.col("artista_nombre"))
    rows = t.pistas.filter((F.size(a) > 0) & (F.size(b) > 0))
    return rows.select("id", F.round(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)), 6).alias("trigramas"))


@query()
def text_combined_similarity(t: Tables) -> DataFrame:
    """Title against album title by sequence ratio, words and trigrams."""
    a, b = F.col("titulo"), F.col("album_titulo")
    return t.pistas.select("id", X.sequence_ratio(X.compare_form(a), X.compare_form(b)).alias("secuencia"), X.combined_similarity(a, b).alias("combinada"))


@query(r"SELECT item_id, try_cast(nullif(regexp_extract(text, '(?:^|[^0-9A-Za-z_])(19[0-9]{2}|20[0-2][0-9])(?:[^0-9A-Za-z_]|$)', 1), '') AS INT) AS anio FROM prueba_items")
def text_year(t: Tables) -> DataFrame:
    return t.prueba_items.select("item_id", X.year_of(F.col("text")).alias("anio"))


@query(r"SELECT id, CASE WHEN try_cast(trim(split_part(regexp_extract(nombre_archivo, '^[0-9]+') || '/12', '/', 1)) AS INT) BETWEEN 1 AND 999 THEN try_cast(trim(split_part(regexp_extract(nombre_archivo, '^[0-9]+') || '/12', '/', 1)) AS INT) END AS pista FROM pistas")
def text_track_number(t: Tables) -> DataFrame:
    return t.pistas.select("id", X.track_number(F.concat(F.regexp_extract("nombre_archivo", "^[0-9]+", 0), F.lit("/12"))).alias("pista"))


@query("""SELECT id, CAST(floor(trunc(duracion_seg) / 60) AS BIGINT) || ':' || lpad(CAST(CAST(trunc(duracion_seg) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS duracion,
genero IS NULL OR trim(genero) = '' AS sin_genero FROM pistas WHERE duracion_seg >= 0""")
def text_labels(t: Tables) -> DataFrame:
    """m:ss and the blank test."""
    return t.pistas.filter("duracion_seg >= 0").select("id", X.minutes_seconds(F.col("duracion_seg")).alias("duracion"), X.is_blank(F.col("genero")).alias("sin_genero"))


@query(r"SELECT id, CASE WHEN regexp_matches(upper(regexp_replace(isrc, '[\s\-]', '', 'g')), '^[A-Z]{2}[A-Z0-9]{3}[0-9]{7}$') THEN upper(regexp_replace(isrc, '[\s\-]', '', 'g')) END AS isrc FROM pistas")
def text_isrc(t: Tables) -> DataFrame:
    return t.pistas.select("id", X.isrc_code(F.col("isrc")).alias("isrc"))


VARIANT_SQL = "CASE " + " ".join(f"WHEN regexp_matches(titulo, '(?i){p}') THEN '{k}'" for k, p in X.VARIANTS.items()) + " END"


@query(rf"""SELECT id, {VARIANT_SQL} AS variante, CASE WHEN {VARIANT_SQL} IS NOT NULL THEN coalesce(nullif(trim(regexp_replace(titulo,
'\s*[\(\[]\s*(?:(?:[^\)\]]*\s+)?(?:remix|rmx|rework|bootleg|flip|[a-z]+ mix)|live(?:\s+[^\)\]]*)?|en vivo|acoustic(?:\s+version)?|instrumental|demo(?:\s+version)?)\s*[\)\]]', '', 'gi')), ''), titulo) ELSE titulo END AS base FROM pistas""")
def text_variant(t: Tables) -> DataFrame:
    """The variant of a recording and the title without it."""
    return t.pistas.select("id", X.variant_type(F.col("titulo")).alias("variante"), X.variant_base(F.col("titulo")).alias("base"))


@query("""SELECT id, CASE WHEN ruta_archivo IS NULL OR trim(ruta_archivo) = '' THEN 'vacia' WHEN list_contains(string_split(ruta_archivo, '/'), '..') THEN 'sube'
WHEN NOT starts_with(ruta_archivo, '/musica/') THEN 'fuera' ELSE '' END AS problema FROM pistas""")
def text_safe_path(t: Tables) -> DataFrame:
    return t.pistas.select("id", X.path_problem(F.col("ruta_archivo"), "/musica").alias("problema"))


_COUNTS = ", ".join(f"len(regexp_extract_all(titulo, '{p}')) AS {k}" for k, p in X.SCRIPTS.items())
_MOST = "greatest(" + ", ".join(X.SCRIPTS) + ")"


@query(rf"""WITH n AS (SELECT id, titulo, len(regexp_extract_all(titulo, '\p{{L}}')) AS todas, {_COUNTS} FROM pistas)
SELECT id, CASE WHEN {_MOST} = 0 THEN 'latino' {" ".join(f"WHEN {k} = {_MOST} THEN '{k}'" for k in X.SCRIPTS)} END AS escritura, todas = latino AS solo_latino FROM n""")
def text_scripts(t: Tables) -> DataFrame:
    """The dominant script of a title and whether all its letters are Latin."""
    return t.pistas.select("id", X.dominant_script(F.col("titulo")).alias("escritura"), X.all_latin(F.col("titulo")).alias("solo_latino"))


@query(r"""WITH b AS (SELECT id, titulo, regexp_replace(titulo, '[^\p{L}\p{N}]', '', 'g') AS c FROM pistas)
SELECT id, upper(substr(c, 1, 1)) AS empieza, upper(right(c, 1)) AS termina, CAST(len(list_filter(string_split(trim(regexp_replace(titulo, '[\s\p{Z}]+', ' ', 'g')), ' '), lambda w: w <> '')) AS INT) AS palabras,
CAST(length(c) AS INT) AS letras, CAST(length(titulo) AS INT) AS total FROM b""")
def text_hints(t: Tables) -> DataFrame:
    return t.pistas.select("id", X.hints(F.col("titulo")).alias("h")).select("id", "h.*")


@query()
def text_guess_check(t: Tables) -> DataFrame:
    """The title guessed from the file name: hit from ratio 0.84, near from 0.62."""
    real, guess = X.canonical(F.col("titulo")), X.canonical(F.regexp_replace("nombre_archivo", r"^\d+ - |\.[a-z0-9]+$", ""))
    r = F.when((real == "") | (guess == ""), 0.0).when(real == guess, 1.0).otherwise(X.sequence_ratio(F.substring(real, 1, 200), F.substring(guess, 1, 200)))
    return t.pistas.select("id", r.alias("r")).select("id", (F.col("r") >= 0.84).alias("acierto"), F.col("r").between(0.62, 0.8399999).alias("cerca"), F.bround("r", 4).alias("ratio"))


@query("""WITH x AS (SELECT id, greatest(0, CAST(round_even(duracion_seg * 10, 0) AS BIGINT)) AS s, greatest(0, CAST(trunc(duracion_seg * 700) AS BIGINT)) AS d FROM pistas WHERE duracion_seg IS NOT NULL)
SELECT id, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm ' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || 's' ELSE (s // 3600) || 'h ' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || 'm' END AS eta,
coalesce(nullif(concat_ws(' ', CASE WHEN d // 86400 > 0 THEN (d // 86400) || 'd' END, CASE WHEN d % 86400 // 3600 > 0 THEN (d % 86400 // 3600) || 'h' END, CASE WHEN d % 3600 // 60 > 0 THEN (d % 3600 // 60) || 'm' END, CASE WHEN d % 60 > 0 THEN (d % 60) || 's' END), ''), '0s') AS duracion FROM x""")
def text_time_labels(t: Tables) -> DataFrame:
    """Labels of remaining time and of long durations, here of multiples of the tracks' lengths."""
    return t.pistas.filter("duracion_seg is not null").select("id", X.eta_label(F.col("duracion_seg") * 10).alias("eta"), X.duration_label(F.col("duracion_seg") * 700).alias("duracion"))
