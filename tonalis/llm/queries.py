"""Registered queries of the operators in this package."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonalis.llm import garbled, leakage, names, neighbours, packing
from tonalis.llm import survivors as survivors_op
from tonalis.llm.top_groups import top_items
from tonalis.plans.registry import Registry
from tonalis.tables import Tables

query = Registry()


def _top(t: Tables) -> DataFrame:
    return top_items(t.score_detalle, t.pista_candidata, item="pista_id", tie="sesion_id", score="score_total", parent_id="id", group="artista_id", rejected="descartada")


_TOP = """WITH s AS (SELECT DISTINCT sesion_id, pista_id, score_total FROM score_detalle
  WHERE NOT coalesce(descartada, false) AND score_total IS NOT NULL AND NOT isnan(score_total)),
r AS (SELECT p.artista_id, s.sesion_id, s.pista_id, s.score_total,
  row_number() OVER (PARTITION BY p.artista_id ORDER BY s.score_total DESC, s.pista_id, s.sesion_id) AS puesto
  FROM s JOIN pista_candidata p ON p.id = s.pista_id WHERE p.artista_id IS NOT NULL)
"""


@query(_TOP + "SELECT artista_id, sesion_id, pista_id FROM r WHERE puesto <= 5")
def p4_found(t: Tables) -> DataFrame:
    """The five best scored candidates of every artist."""
    return _top(t).select("artista_id", "sesion_id", "pista_id")


@query(_TOP + "SELECT artista_id, sesion_id, pista_id, score_total, CAST(puesto AS INTEGER) AS puesto FROM r WHERE puesto <= 5")
def p4_ranked(t: Tables) -> DataFrame:
    """The same with score and rank."""
    return _top(t)


def _bare(column: str, label: str, whole: str) -> str:
    bare = f"regexp_replace(upper({column}), '[\\s\\p{{Z}}{{}}\\-]', '', 'g')"
    return f"CASE WHEN regexp_matches({bare}, '{whole}') THEN {bare} ELSE regexp_replace({bare}, '^(?:{label})', '') END"


_SURVIVORS = f"""WITH RECURSIVE n AS (SELECT id, actualizado_en AS t, CASE WHEN bitrate_kbps BETWEEN 32 AND 2000 THEN bitrate_kbps END AS b,
  {_bare("isrc", "ISRC:?", "^[A-Z]{2}[A-Z0-9]{3}[0-9]{7}$")} AS i,
  {_bare("hash_sha256", "SHA256:", "^[0-9A-F]{64}$")} AS h,
  {_bare("mb_recording_id", "URN:UUID:", "^[0-9A-F]{32}$")} AS m FROM pistas),
u AS (SELECT id, t, b,
  CASE WHEN regexp_matches(i, '^[A-Z]{{2}}[A-Z0-9]{{3}}[0-9]{{7}}$') AND substr(i, 3) <> repeat(substr(i, 3, 1), 10) THEN i END AS i,
  CASE WHEN regexp_matches(h, '^[0-9A-F]{{64}}$') AND h <> repeat(h[1], 64) THEN h END AS h,
  CASE WHEN regexp_matches(m, '^[0-9A-F]{{32}}$') AND m <> repeat(m[1], 32) THEN m END AS m FROM n),
k AS (SELECT id, 'i' || i AS k FROM u WHERE i IS NOT NULL UNION SELECT id, 'h' || h FROM u WHERE h IS NOT NULL UNION SELECT id, 'm' || m FROM u WHERE m IS NOT NULL),
e AS (SELECT DISTINCT a.id AS a, b.id AS b FROM k a JOIN k b ON a.k = b.k WHERE a.id <> b.id),
r AS (SELECT DISTINCT a AS id, a AS root FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.root),
g AS (SELECT r.id, min(root) AS grupo_id FROM r GROUP BY r.id),
w AS (SELECT g.grupo_id, u.*, (i IS NOT NULL)::INT + (h IS NOT NULL)::INT + (m IS NOT NULL)::INT + (b IS NOT NULL)::INT AS c FROM g JOIN u ON u.id = g.id),
x AS (SELECT grupo_id, 'isrc' AS campo, id, row_number() OVER (PARTITION BY grupo_id ORDER BY t DESC, id) AS n FROM w WHERE i IS NOT NULL
 UNION ALL SELECT grupo_id, 'hash_sha256', id, row_number() OVER (PARTITION BY grupo_id ORDER BY t DESC, id) FROM w WHERE h IS NOT NULL
 UNION ALL SELECT grupo_id, 'mb_recording_id', id, row_number() OVER (PARTITION BY grupo_id ORDER BY t DESC, id) FROM w WHERE m IS NOT NULL
 UNION ALL SELECT grupo_id, 'bitrate_kbps', id, row_number() OVER (PARTITION BY grupo_id ORDER BY b DESC, t DESC, id) FROM w WHERE b IS NOT NULL
 UNION ALL SELECT grupo_id, 'registro', id, row_number() OVER (PARTITION BY grupo_id ORDER BY c DESC, coalesce(b, -1) DESC, t DESC, id) FROM w)
SELECT grupo_id, campo, id AS pista_id FROM x WHERE n = 1"""


@query(_SURVIVORS)
def p5_found(t: Tables) -> DataFrame:
    """The row that supplies each field of the surviving record of every duplicate group."""
    return survivors_op.survivors(t.pistas)


_GROUPS = _SURVIVORS[: _SURVIVORS.index("w AS (SELECT g.grupo_id")]
_PRECEDENCE = """a AS (SELECT g.grupo_id, 'estado' AS campo, coalesce(p.estado, '') AS valor, u.t FROM g JOIN u USING (id) JOIN pistas p USING (id)
 UNION ALL SELECT g.grupo_id, 'bitrate_kbps', CAST(u.b AS VARCHAR), u.t FROM g JOIN u USING (id) WHERE u.b IS NOT NULL),
f AS (SELECT grupo_id, campo, valor, min(t) AS since FROM a WHERE t IS NOT NULL GROUP BY 1, 2, 3),
v AS (SELECT campo, lag(valor) OVER w AS antes, valor AS despues, lag(since) OVER w < since AS later FROM f WINDOW w AS (PARTITION BY grupo_id, campo ORDER BY since, valor)),
c AS (SELECT campo, antes, despues, count(*) AS n FROM v WHERE later GROUP BY 1, 2, 3),
pr AS (SELECT c.campo, c.antes, c.despues, c.n FROM c LEFT JOIN c b ON b.campo = c.campo AND b.antes = c.despues AND b.despues = c.antes WHERE c.n >= 3 AND c.n >= 0.6 * (c.n + coalesce(b.n, 0)))
"""


@query(_GROUPS + _PRECEDENCE + "SELECT * FROM pr")
def p5_precedence(t: Tables) -> DataFrame:
    """The learned precedence between values of a track's fields, with the number of groups that show it."""
    return survivors_op.learn_precedence(survivors_op.grouped(t.pistas))


_UNDATED = (
    (_GROUPS + _PRECEDENCE).replace("actualizado_en", "ultimo_acceso")
    + """, ne AS (SELECT campo, valor, sum(g) AS s FROM (SELECT campo, despues AS valor, n AS g FROM pr UNION ALL SELECT campo, antes, -n FROM pr) GROUP BY 1, 2),
o AS (SELECT pr.campo, pr.antes, pr.despues FROM pr JOIN ne l ON l.campo = pr.campo AND l.valor = pr.antes JOIN ne h ON h.campo = pr.campo AND h.valor = pr.despues WHERE l.s < h.s OR l.s = h.s AND l.valor < h.valor),
hv AS (SELECT DISTINCT grupo_id, campo, valor FROM a),
ed AS (SELECT x.grupo_id, x.campo, o.antes, o.despues FROM hv x JOIN o ON o.campo = x.campo AND o.antes = x.valor JOIN hv y ON y.grupo_id = x.grupo_id AND y.campo = x.campo AND y.valor = o.despues),
cl AS (SELECT * FROM ed UNION SELECT cl.grupo_id, cl.campo, cl.antes, ed.despues FROM cl JOIN ed ON ed.grupo_id = cl.grupo_id AND ed.campo = cl.campo AND ed.antes = cl.despues),
w AS (SELECT g.grupo_id, u.*, coalesce(p.estado, '') AS s, (i IS NOT NULL)::INT + (h IS NOT NULL)::INT + (m IS NOT NULL)::INT + (b IS NOT NULL)::INT AS c FROM g JOIN u ON u.id = g.id JOIN pistas p ON p.id = g.id),
fd AS (SELECT grupo_id, 'isrc' AS de, id, t, s, b FROM w WHERE i IS NOT NULL UNION ALL SELECT grupo_id, 'hash_sha256', id, t, s, b FROM w WHERE h IS NOT NULL UNION ALL SELECT grupo_id, 'mb_recording_id', id, t, s, b FROM w WHERE m IS NOT NULL),
da AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grupo_id, de ORDER BY t DESC, id) AS k FROM fd WHERE t IS NOT NULL) WHERE k = 1),
lo AS (SELECT grupo_id, de, s, b, min(id) AS id FROM fd WHERE t IS NULL GROUP BY 1, 2, 3, 4),
ca AS (SELECT grupo_id, de, s, b, true AS dated FROM da UNION ALL SELECT grupo_id, de, s, b, false FROM lo),
pa AS (SELECT y.grupo_id, y.de, y.s, y.b, x.s AS xs, x.b AS xb, bool_or(x.dated) AS dated FROM lo y JOIN ca x ON x.grupo_id = y.grupo_id AND x.de = y.de
 LEFT JOIN cl e1 ON e1.grupo_id = y.grupo_id AND e1.campo = 'estado' AND e1.antes = x.s AND e1.despues = y.s LEFT JOIN cl e2 ON e2.grupo_id = y.grupo_id AND e2.campo = 'estado' AND e2.antes = y.s AND e2.despues = x.s
 LEFT JOIN cl b1 ON b1.grupo_id = y.grupo_id AND b1.campo = 'bitrate_kbps' AND b1.antes = CAST(x.b AS VARCHAR) AND b1.despues = CAST(y.b AS VARCHAR) LEFT JOIN cl b2 ON b2.grupo_id = y.grupo_id AND b2.campo = 'bitrate_kbps' AND b2.antes = CAST(y.b AS VARCHAR) AND b2.despues = CAST(x.b AS VARCHAR)
 WHERE (e1.antes IS NOT NULL OR b1.antes IS NOT NULL) AND e2.antes IS NULL AND b2.antes IS NULL GROUP BY 1, 2, 3, 4, 5, 6),
de AS (SELECT grupo_id, de, s, b, count(*) AS n, bool_or(dated) AS follows FROM pa GROUP BY 1, 2, 3, 4),
ch AS (SELECT lo.grupo_id, lo.de, lo.id, row_number() OVER (PARTITION BY lo.grupo_id, lo.de ORDER BY coalesce(de.n, 0) DESC, lo.id) AS k FROM lo LEFT JOIN de ON de.grupo_id = lo.grupo_id AND de.de = lo.de AND de.s = lo.s AND de.b IS NOT DISTINCT FROM lo.b
 LEFT JOIN da ON da.grupo_id = lo.grupo_id AND da.de = lo.de WHERE da.id IS NULL OR coalesce(de.follows, false)),
x AS (SELECT grupo_id, 'bitrate_kbps' AS campo, id, row_number() OVER (PARTITION BY grupo_id ORDER BY b DESC, t DESC NULLS LAST, id) AS n FROM w WHERE b IS NOT NULL
 UNION ALL SELECT grupo_id, 'registro', id, row_number() OVER (PARTITION BY grupo_id ORDER BY c DESC, coalesce(b, -1) DESC, t DESC NULLS LAST, id) FROM w)
SELECT grupo_id, campo, id AS pista_id, false AS por_orden FROM x WHERE n = 1
UNION ALL SELECT grupo_id, de, id, true FROM ch WHERE k = 1
UNION ALL SELECT da.grupo_id, da.de, da.id, false FROM da LEFT JOIN ch ON ch.grupo_id = da.grupo_id AND ch.de = da.de AND ch.k = 1 WHERE ch.id IS NULL"""
)


@query(_UNDATED)
def p5_undated(t: Tables) -> DataFrame:
    """The surviving rows by the time of last use, which many rows lack: there the learned order of states and bitrates decides."""
    return survivors_op.current_rows(t.pistas, "ultimo_acceso")


def _runs(table: str, key: str) -> str:
    """The distinct runs of eight words of every text, in SQL."""
    return rf"""(SELECT DISTINCT {key}, g FROM (SELECT {key}, unnest(list_transform(range(1, len(w) - 6), lambda k: array_to_string(w[k:k + 7], ' '))) AS g
 FROM (SELECT {key}, regexp_extract_all(strip_accents(lower(text)), '[\p{{L}}\p{{N}}]+') AS w FROM {table}) WHERE len(w) >= 8))"""


@query(f"SELECT DISTINCT d.doc_id, i.item_id FROM {_runs('documents', 'doc_id')} d JOIN {_runs('prueba_items', 'item_id')} i USING (g)")
def p7_found(t: Tables) -> DataFrame:
    """The test items that leaked into each document."""
    return leakage.find_leaks(t.documents, t.prueba_items).select("doc_id", "item_id")


@query()
def p7_overlap(t: Tables) -> DataFrame:
    """The same with the number of words of the document that come from the item."""
    return leakage.find_leaks(t.documents, t.prueba_items)


@query()
def p8_found(t: Tables) -> DataFrame:
    """The documents with at least one word in the wrong encoding."""
    return garbled.restore(t.documents).select("doc_id").distinct()


@query()
def p8_restored(t: Tables) -> DataFrame:
    """The same with the restored text."""
    return garbled.restore(t.documents)


@query()
def p1_found(t: Tables) -> DataFrame:
    """The pairs of tracks of which one is among the five nearest of the other."""
    near = neighbours.track_neighbours(t.ejes_pista)
    return near.select(F.least("pista_id", "vecino_id").alias("pista_a"), F.greatest("pista_id", "vecino_id").alias("pista_b")).distinct()


@query()
def p1_neighbours(t: Tables) -> DataFrame:
    """The five nearest of every track, with rank and similarity."""
    return neighbours.track_neighbours(t.ejes_pista)


@query()
def p3_found(t: Tables) -> DataFrame:
    """All pairs of different spellings of one artist."""
    return names.spelling_pairs(names.link_spellings(names.artist_spellings(t.artistas, t.pistas)))


@query()
def p3_linked(t: Tables) -> DataFrame:
    """Each spelling with the number of the artist it means."""
    return names.link_spellings(names.artist_spellings(t.artistas, t.pistas))


@query()
def p6_packed(t: Tables) -> DataFrame:
    """Every document in a window of each container."""
    return packing.pack(t.documents, t.contenedores)


@query()
def p6_placed(t: Tables) -> DataFrame:
    """The share of tokens that opened windows, followed as neighbours, and were placed by size alone."""
    return packing.placed(packing.pack(t.documents, t.contenedores, reasons=True))


@query()
def p6_filling(t: Tables) -> DataFrame:
    """How well the windows of each container are filled."""
    return packing.filling(packing.pack(t.documents, t.contenedores), t.contenedores)
