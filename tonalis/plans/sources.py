"""Readers, writers and changes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonalis.functions.text import slug
from tonalis.materialise import shared_folder
from tonalis.operators.library import in_library
from tonalis.plans.registry import Registry
from tonalis.plans.text import _SLUG
from tonalis.sources import changes as C
from tonalis.sources import files as S
from tonalis.sources import jsonl as J
from tonalis.tables import Tables

query = Registry()


@query()
def source_files(t: Tables) -> DataFrame:
    """Every table file of the folder with its size and three digests."""
    f = S.scan_files(t.spark, t.folder, "*.parquet").filter(S.extension(F.col("nombre")) == ".parquet").filter("bytes > 0")
    return S.digests(f).select(F.substring_index("path", "/", -1).alias("nombre"), "bytes", "entero", "cabeza", "extremos")


@query("""SELECT id, CASE WHEN NOT coalesce(tamano_bytes >= 1000000, false) THEN 'pequeno' WHEN NOT coalesce(duracion_seg BETWEEN 30 AND 3600, false) THEN 'duracion' WHEN NOT coalesce(bitrate_kbps BETWEEN 64 AND 2000, false) THEN 'bitrate' END AS causa FROM pistas""")
def source_validation(t: Tables) -> DataFrame:
    """The first check that a file fails."""
    rules = {"pequeno": F.col("tamano_bytes") >= 1_000_000, "duracion": F.col("duracion_seg").between(30, 3600), "bitrate": F.col("bitrate_kbps").between(64, 2000)}
    return t.pistas.select("id", S.first_failure(rules).alias("causa"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events WHERE event_type <> 'error' GROUP BY 1")
def source_jsonl(t: Tables) -> DataFrame:
    """An event log written as JSON lines and read back: the last value of each key that is no error."""
    path = f"{shared_folder(t.spark)}/tonalis-jsonl/{uuid.uuid4().hex}"
    lines = t.events.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.when(F.col("event_type") != "error", F.col("event_type")).otherwise("").alias("event_type"))
    J.write_jsonl(lines, path)
    back = J.read_jsonl(t.spark, path, "user_id bigint, event_id bigint, us bigint, event_type string")
    return J.last_by_key(back, "user_id", F.struct("us", "event_id"), "event_type")


@query("""SELECT artista_id, list_sort(list(DISTINCT genero)) AS generos, count(*) AS n FROM pistas WHERE artista_id IS NOT NULL AND genero IS NOT NULL GROUP BY 1""")
def source_manifests(t: Tables) -> DataFrame:
    """A manifest per artist: the union of the sets of its tracks."""
    return t.pistas.filter("artista_id is not null and genero is not null").groupBy("artista_id").agg(F.array_sort(F.collect_set("genero")).alias("generos"), F.count("*").alias("n"))


@query("""WITH b AS (SELECT id, actualizado_en AS t, titulo, 1 AS nuevo FROM pistas WHERE estado <> 'biblioteca' UNION ALL SELECT id, indexado_en, titulo || ' *', 0 FROM pistas) SELECT id, arg_max(titulo, (t, nuevo)) AS titulo, max(t) AS t FROM b GROUP BY id""")
def source_upsert(t: Tables) -> DataFrame:
    old = t.pistas.select("id", F.col("indexado_en").alias("t"), F.concat("titulo", F.lit(" *")).alias("titulo"))
    new = t.pistas.filter("estado <> 'biblioteca'").select("id", F.col("actualizado_en").alias("t"), "titulo")
    return C.upsert(old, new, ["id"], "t").select("id", "titulo", "t")


@query("""WITH l AS (SELECT * FROM pistas WHERE estado = 'biblioteca'), i AS (SELECT ruta_archivo, hash_sha256 FROM pistas WHERE estado <> 'biblioteca' OR favorita = 1),
k AS (SELECT DISTINCT hash_sha256 FROM l WHERE hash_sha256 IS NOT NULL)
SELECT i.ruta_archivo, CASE WHEN l.id IS NOT NULL AND l.hash_sha256 IS NOT DISTINCT FROM i.hash_sha256 THEN 'omitir' WHEN l.id IS NOT NULL THEN 'actualizar' WHEN k.hash_sha256 IS NOT NULL THEN 'rechazar' ELSE 'insertar' END AS accion
FROM i LEFT JOIN l ON l.ruta_archivo = i.ruta_archivo LEFT JOIN k ON k.hash_sha256 = i.hash_sha256""")
def source_index_actions(t: Tables) -> DataFrame:
    incoming = t.pistas.filter("estado <> 'biblioteca' or favorita = 1").select("ruta_archivo", "hash_sha256")
    return C.index_actions(incoming, in_library(t.pistas))


_S = "coalesce(nullif(" + _SLUG.format("artista_nombre") + ", ''), 'sin_titulo')"


@query(f"""WITH w AS (SELECT DISTINCT {_S} AS nombre_slug FROM pistas), n AS (SELECT nombre_slug, row_number() OVER (ORDER BY encode(nombre_slug)) AS k FROM w WHERE nombre_slug NOT IN (SELECT nombre_slug FROM artistas))
SELECT w.nombre_slug, coalesce(a.id, (SELECT max(id) FROM artistas) + n.k) AS id, a.id IS NULL AS nueva FROM w LEFT JOIN artistas a USING (nombre_slug) LEFT JOIN n USING (nombre_slug)""")
def source_assign_artists(t: Tables) -> DataFrame:
    """The artist of every typed name by its slug, with new numbers for those without one."""
    rows = t.pistas.select(slug(F.col("artista_nombre")).alias("nombre_slug"))
    return C.assign_keys(rows, t.artistas, ["nombre_slug"], "id").select("nombre_slug", "id", "nueva")


@query("""SELECT h.id, h.pista_id FROM (SELECT DISTINCT id, pista_id FROM historial) h WHERE h.pista_id IS NULL OR h.pista_id NOT IN (SELECT id FROM pistas WHERE estado = 'cuarentena')""")
def source_cascade(t: Tables) -> DataFrame:
    """The play log after the removal of the tracks in quarantine."""
    return C.without(t.historial.select("id", "pista_id").distinct(), t.pistas.filter("estado = 'cuarentena'"), "pista_id", "id")


@query("SELECT b.id FROM albums b WHERE b.id NOT IN (SELECT album_id FROM pistas WHERE estado = 'biblioteca' AND album_id IS NOT NULL)")
def source_orphans(t: Tables) -> DataFrame:
    return C.orphans(t.albums.select("id"), in_library(t.pistas).filter("album_id is not null"), "id", "album_id")


@query("""WITH o AS (SELECT sesion_id, pista_id, min(epoch_us(registrado_en)) AS p FROM score_detalle GROUP BY 1, 2) SELECT sesion_id, pista_id, row_number() OVER (PARTITION BY sesion_id ORDER BY p, pista_id) AS posicion FROM o QUALIFY posicion <= 100""")
def source_replace_members(t: Tables) -> DataFrame:
    """Membership from the order of arrival: each item once, a hundred a list, renumbered."""
    items = t.score_detalle.select("sesion_id", "pista_id", F.unix_micros(F.col("registrado_en").cast("timestamp")).alias("us"))
    return C.replace_members(items, "sesion_id", "pista_id", "us", 100)


@query("""SELECT id, CASE WHEN track_number = 3 THEN 7 WHEN track_number BETWEEN 4 AND 7 THEN track_number - 1 ELSE track_number END AS posicion FROM pistas WHERE track_number IS NOT NULL""")
def source_move(t: Tables) -> DataFrame:
    """The element at place 3 of every album moved to place 7."""
    return t.pistas.filter("track_number is not null").select("id", C.move(F.col("track_number"), 3, 7).alias("posicion"))


@query("""SELECT id, CAST(u.n AS INT) AS posicion, try_cast(trim(u.x) AS BIGINT) AS pista_id FROM (SELECT id, string_split(id || ', ' || coalesce(CAST(album_id AS VARCHAR), 'x') || ',' || coalesce(isrc, ''), ',') AS q FROM pistas), LATERAL (SELECT unnest(q) AS x, unnest(range(1, len(q) + 1)) AS n) u WHERE try_cast(trim(u.x) AS BIGINT) IS NOT NULL""")
def source_queue(t: Tables) -> DataFrame:
    """Queues kept as text."""
    q = t.pistas.select("id", F.concat(F.col("id").cast("string"), F.lit(", "), F.coalesce(F.col("album_id").cast("string"), F.lit("x")), F.lit(","), F.coalesce("isrc", F.lit(""))).alias("q"))
    return C.parse_queue(q, "id", "q")


@query("""SELECT id, coalesce('mb:' || lower(nullif(trim(mb_recording_id), '')), 'isrc:' || upper(nullif(trim(isrc), '')), 'sha:' || lower(nullif(trim(hash_sha256), '')), 'ruta:' || sha1(ruta_archivo)) AS clave FROM pistas""")
def source_canonical_id(t: Tables) -> DataFrame:
    return t.pistas.select("id", C.canonical_id().alias("clave"))


@query("""SELECT id, track_number AS una, CASE WHEN track_number + 1 < 12 THEN track_number + 1 END AS ninguna, (track_number + 1) % 12 AS todas FROM pistas WHERE track_number IS NOT NULL""")
def source_cursor(t: Tables) -> DataFrame:
    """The next place in a queue of twelve under each way to repeat."""
    i, n = F.col("track_number"), F.lit(12)
    return t.pistas.filter("track_number is not null").select("id", C.next_index(i, n, "one").alias("una"), C.next_index(i, n, "none").alias("ninguna"), C.next_index(i, n, "all").alias("todas"))


@query("""SELECT id, CASE WHEN estado = 'revision' THEN 'falta' ELSE 'distinto' END AS estado FROM pistas WHERE estado = 'revision' OR (estado = 'cuarentena' AND hash_sha256 IS NOT NULL)""")
def source_backup_check(t: Tables) -> DataFrame:
    """Two lists of checksums compared: here one lacks some entries and has others changed."""
    a = t.pistas.select("id", F.coalesce("hash_sha256", F.lit("-")).alias("d"))
    b = t.pistas.filter("estado <> 'revision'").select("id", F.when((F.col("estado") == "cuarentena") & F.col("hash_sha256").isNotNull(), "x").otherwise(F.coalesce("hash_sha256", F.lit("-"))).alias("d"))
    return S.checksum_differences(a, b, "id", "d")


@query("SELECT count(*) = count(DISTINCT id) AS permutacion FROM pistas")
def source_permutation(t: Tables) -> DataFrame:
    """Whether one order of the library is a permutation of another."""
    ids = t.pistas.select("id")
    return t.spark.range(1).select(C.is_permutation(ids, ids.orderBy(F.desc("id"))).alias("permutacion"))


@query("SELECT id, coalesce(nullif(trim(isrc), ''), nullif(trim(mb_recording_id), ''), nullif(trim(titulo), '')) AS clave FROM pistas")
def source_first_present(t: Tables) -> DataFrame:
    return t.pistas.select("id", J.first_present("isrc", "mb_recording_id", "titulo").alias("clave"))


@query("""WITH a AS (SELECT album_id, id AS pista_id, titulo, indexado_en AS t, [genero] AS g, 0 AS n FROM pistas WHERE album_id IS NOT NULL AND genero IS NOT NULL UNION ALL SELECT album_id, id, titulo || ' *', actualizado_en, [estado], 1 FROM pistas WHERE album_id IS NOT NULL AND genero IS NOT NULL AND estado <> 'biblioteca')
SELECT album_id, pista_id, arg_max(titulo, (t, n)) AS titulo, max(t) AS t, list_sort(list_distinct(flatten(list(g)))) AS etiquetas FROM a GROUP BY 1, 2""")
def source_merge(t: Tables) -> DataFrame:
    """Album manifests merged by track, their sets united."""
    own = t.pistas.filter("album_id is not null and genero is not null")
    old = own.select("album_id", F.col("id").alias("pista_id"), "titulo", F.col("indexado_en").alias("t"), F.array("genero").alias("etiquetas"))
    new = own.filter("estado <> 'biblioteca'").select("album_id", F.col("id").alias("pista_id"), F.concat("titulo", F.lit(" *")).alias("titulo"), F.col("actualizado_en").alias("t"), F.array("estado").alias("etiquetas"))
    return C.merged_entries(old, new, "album_id", "pista_id", "t", ["etiquetas"])


_SA = "coalesce(nullif(" + _SLUG.format("album_titulo") + ", ''), 'sin_titulo')"


@query(f"""WITH w AS (SELECT DISTINCT artista_id, {_SA} AS titulo_slug FROM pistas WHERE artista_id IS NOT NULL), h AS (SELECT artista_id, titulo_slug, min(id) AS id FROM albums GROUP BY 1, 2), n AS (SELECT w.*, row_number() OVER (ORDER BY w.artista_id, encode(w.titulo_slug)) AS k FROM w LEFT JOIN h USING (artista_id, titulo_slug) WHERE h.id IS NULL)
SELECT w.artista_id, w.titulo_slug, coalesce(h.id, (SELECT max(id) FROM albums) + n.k) AS id, h.id IS NULL AS nueva FROM w LEFT JOIN h USING (artista_id, titulo_slug) LEFT JOIN n USING (artista_id, titulo_slug)""")
def source_assign_albums(t: Tables) -> DataFrame:
    """The album of every track by artist and slug, with new numbers for those without one."""
    rows = t.pistas.select("artista_id", slug(F.col("album_titulo")).alias("titulo_slug"))
    return C.assign_keys(rows, t.albums, ["artista_id", "titulo_slug"], "id").select("artista_id", "titulo_slug", "id", "nueva")


@query("""WITH g AS (SELECT id FROM pistas WHERE estado = 'cuarentena') SELECT 'historial' AS tabla, count(*) AS n FROM historial WHERE pista_id IS NULL OR pista_id NOT IN (SELECT id FROM g) UNION ALL SELECT 'score_detalle', count(*) FROM score_detalle WHERE pista_id NOT IN (SELECT id FROM g)
UNION ALL SELECT 'ejes_pista', count(*) FROM ejes_pista WHERE pista_id NOT IN (SELECT id FROM g) UNION ALL SELECT 'pista_candidata', count(*) FROM pista_candidata WHERE id NOT IN (SELECT id FROM g) UNION ALL SELECT 'lapidas', count(*) FROM g""")
def source_cascade_all(t: Tables) -> DataFrame:
    """The rows of every dependent table after tracks in quarantine are removed, and their tombstones."""
    children = {"historial": (t.historial, "pista_id"), "score_detalle": (t.score_detalle, "pista_id"), "ejes_pista": (t.ejes_pista, "pista_id"), "pista_candidata": (t.pista_candidata, "id")}
    left, tombs = C.cascade(t.pistas.filter("estado = 'cuarentena'"), "id", children, 1)
    out = tombs.agg(F.lit("lapidas").alias("tabla"), F.count("*").alias("n")).select("tabla", "n")
    for name, df in left.items():
        out = out.unionByName(df.agg(F.lit(name).alias("tabla"), F.count("*").alias("n")).select("tabla", "n"))
    return out


@query("""WITH p AS (SELECT user_id, event_type, count(*) AS n, sum(value) AS s FROM events GROUP BY 1, 2) SELECT user_id, CAST(sum(n) AS BIGINT) AS total, round(sum(s), 3) AS segundos, CAST(sum(n) FILTER (event_type = 'error') AS BIGINT) AS errores FROM p GROUP BY 1""")
def source_report(t: Tables) -> DataFrame:
    """Reports of runs written as JSON lines and read back; here a user is a run and an event type a state."""
    path = f"{shared_folder(t.spark)}/tonalis-reports/{uuid.uuid4().hex}"
    J.write_jsonl(C.run_report(t.events, "user_id", "event_type", "value"), path)
    back = J.read_jsonl(t.spark, path, "user_id bigint, informe string")
    r = F.from_json("informe", "total bigint, segundos double, estados map<string,bigint>")
    return back.select("user_id", r["total"].alias("total"), r["segundos"].alias("segundos"), r["estados"]["error"].alias("errores"))


@query("SELECT artista_id, count(*) AS n, round(sum(duracion_seg), 2) AS duracion FROM pistas WHERE artista_id IS NOT NULL GROUP BY 1")
def source_swap(t: Tables) -> DataFrame:
    """A table replaced whole, twice, and read back."""
    path = f"{shared_folder(t.spark)}/tonalis-swap/{uuid.uuid4().hex}"
    per = t.pistas.filter("artista_id is not null").groupBy("artista_id").agg(F.count("*").alias("n"), F.round(F.sum("duracion_seg"), 2).alias("duracion"))
    C.swap_in(per.filter("n > 1"), path)
    C.swap_in(per, path)
    return t.spark.read.schema(per.schema).parquet(path)


@query("""SELECT nombre, extension FROM (VALUES ('albums.parquet', '.parquet'), ('artistas.parquet', '.parquet'), ('documents.parquet', '.parquet'), ('historial.parquet', '.parquet'), ('pistas.parquet', '.parquet')) AS v(nombre, extension)""")
def source_scan(t: Tables) -> DataFrame:
    """The table files of the library by name, extension and least size: a scan that reads no content."""
    f = S.scan_files(t.spark, t.folder).withColumn("extension", S.extension(F.col("nombre")))
    wanted = F.col("nombre").isin("albums.parquet", "artistas.parquet", "documents.parquet", "historial.parquet", "pistas.parquet", "nada.parquet")
    return f.filter(F.col("extension").isin(".parquet", ".mp3") & (F.col("bytes") >= 100) & wanted).select("nombre", "extension").orderBy("nombre")


@query("""WITH b AS (SELECT id AS pista_id, genero AS tag, 'genero' AS fuente, 0.5::DOUBLE AS puntaje, indexado_en AS t, 0 AS n FROM pistas WHERE genero IS NOT NULL UNION ALL SELECT id, tag, 'genero', 0.9::DOUBLE, analizado_en, 1 FROM (SELECT id, unnest(vibe_tags) AS tag, analizado_en FROM pista_candidata)
UNION ALL SELECT id, genero, 'genero', 0.7::DOUBLE, analizado_en, 1 FROM pista_candidata WHERE genero IS NOT NULL) SELECT pista_id, tag, fuente, arg_max(puntaje, (t, n, puntaje)) AS puntaje, max(t) AS t FROM b GROUP BY 1, 2, 3""")
def source_upsert_tags(t: Tables) -> DataFrame:
    """Tags written over older ones: the key is track, tag and source; of repeated writes the higher score stays."""
    row = lambda df, tag, score, time: df.select(F.col("id").alias("pista_id"), tag.alias("tag"), F.lit("genero").alias("fuente"), F.lit(score).alias("puntaje"), F.col(time).alias("t"))
    old = row(t.pistas.filter("genero is not null"), F.col("genero"), 0.5, "indexado_en")
    new = row(t.pista_candidata.select("id", "analizado_en", F.explode("vibe_tags").alias("g")), F.col("g"), 0.9, "analizado_en").unionByName(row(t.pista_candidata.filter("genero is not null"), F.col("genero"), 0.7, "analizado_en"))
    keys = ["pista_id", "tag", "fuente"]
    once = new.groupBy(*keys, "t").agg(F.max("puntaje").alias("puntaje"))
    return C.upsert(old.select(*keys, "puntaje", "t"), once.select(*keys, "puntaje", "t"), keys, "t")
