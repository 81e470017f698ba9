"""Duplicates by content, identity and looks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonalis.operators import dedupe as D
from tonalis.plans.registry import Registry
from tonalis.plans.text import cmp_sql
from tonalis.tables import Tables

query = Registry()

_KEY = f"CASE WHEN {cmp_sql('titulo')} <> '' AND {cmp_sql('artista_nombre')} <> '' AND {cmp_sql('album_titulo')} <> '' THEN {cmp_sql('titulo')} || chr(31) || {cmp_sql('artista_nombre')} || chr(31) || {cmp_sql('album_titulo')} END"
_ORDER = "favorita DESC, (coalesce(mb_recording_id, '') <> '') DESC, (coalesce(isrc, '') <> '') DESC, coalesce(bitrate_kbps, 0) DESC, tamano_bytes DESC, veces_reproducida DESC, id"
_QUALITY = """round_even(CAST(least(1.0, CASE WHEN coalesce(mb_recording_id, '') <> '' THEN 0.1 ELSE 0 END + CASE WHEN album_id IS NOT NULL THEN 0.08 ELSE 0 END + CASE WHEN coalesce(isrc, '') <> '' THEN 0.06 ELSE 0 END
+ CASE WHEN track_number IS NOT NULL THEN 0.04 ELSE 0 END + CASE WHEN coalesce(bitrate_kbps, 0) >= 256 THEN 0.1 ELSE 0 END + CASE WHEN trim(titulo) <> '' AND trim(artista_nombre) <> '' THEN 0.05 ELSE 0 END) AS DOUBLE), 4)"""


@query("""WITH h AS (SELECT id, nullif(lower(trim(hash_sha256)), '') AS h FROM pistas), f AS (SELECT h, min(id) AS conserva FROM h WHERE h IS NOT NULL GROUP BY h HAVING count(*) > 1)
SELECT id, conserva FROM h JOIN f USING (h) WHERE id <> conserva""")
def dedupe_exact(t: Tables) -> DataFrame:
    return D.repeated_hash(t.pistas)


@query(f"""WITH k AS (SELECT *, {_KEY} AS k FROM pistas), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY {_ORDER}) AS rn, count(*) OVER (PARTITION BY k) AS n FROM k WHERE k IS NOT NULL)
SELECT r.id, b.id AS conserva FROM r JOIN r b ON b.k = r.k AND b.rn = 1 WHERE r.rn > 1 AND abs(r.duracion_seg - b.duracion_seg) <= 3""")
def dedupe_observable(t: Tables) -> DataFrame:
    return D.observable_losers(t.pistas)


@query(f"SELECT md5(k) AS clave, count(*) AS n, min(id) AS primera, min(duracion_seg) AS minimo, max(duracion_seg) AS maximo FROM (SELECT *, {_KEY} AS k FROM pistas) WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 1")
def dedupe_groups(t: Tables) -> DataFrame:
    return D.observable_groups(t.pistas)


@query(f"SELECT id, {_QUALITY} AS calidad FROM pistas")
def dedupe_quality(t: Tables) -> DataFrame:
    return t.pistas.select("id", D.quality_score().alias("calidad"))


_CODE = r"CASE WHEN regexp_matches(upper(regexp_replace(isrc, '[\s\-]', '', 'g')), '^[A-Z]{2}[A-Z0-9]{3}[0-9]{7}$') THEN 'isrc:' || upper(regexp_replace(isrc, '[\s\-]', '', 'g')) END"


@query(f"""WITH q AS (SELECT id, {_QUALITY} AS q, CASE WHEN coalesce(mb_recording_id, '') <> '' THEN 'mb:' || lower(mb_recording_id) END AS m, {_CODE} AS i FROM pistas),
e AS (SELECT id, q, m AS k FROM q WHERE m IS NOT NULL UNION ALL SELECT id, q, i FROM q WHERE i IS NOT NULL), f AS (SELECT k, min(id) AS fid, arg_min(q, id) AS fq FROM e GROUP BY k),
h AS (SELECT e.id, e.q, f.fid, f.fq, row_number() OVER (PARTITION BY e.id ORDER BY f.fid, f.fq) AS rn FROM e JOIN f USING (k) WHERE e.id <> f.fid)
SELECT id, fid AS conserva, CASE WHEN q >= fq + 0.08 THEN 'mejorable' ELSE 'semantico' END AS tipo FROM h WHERE rn = 1""")
def dedupe_identity(t: Tables) -> DataFrame:
    return D.identity_repeats(t.pistas)


@query(f"SELECT id, CAST(row_number() OVER (PARTITION BY artista_id, titulo ORDER BY {_ORDER}) AS INT) AS puesto FROM pistas WHERE artista_id IS NOT NULL")
def dedupe_keep_order(t: Tables) -> DataFrame:
    return D.ranked(t.pistas.filter("artista_id is not null"), F.struct("artista_id", "titulo")).select("id", "puesto")
