"""Queries of the hot-deck operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonalis.operators.hot_deck import LEVELS, fill_tracks
from tonalis.plans.registry import Registry
from tonalis.tables import Tables

query = Registry()

_OK = {"bpm": "bpm > 0 AND bpm <= 300", "energy": "energy BETWEEN 0 AND 1", "mood_sad": "mood_sad BETWEEN 0 AND 1"}
_CASE = "\nUNION ALL\n".join(
    f"""SELECT p.id AS pista_id, '{c}' AS campo FROM pista_candidata p
WHERE p.artista_id IS NOT NULL AND NOT coalesce(NOT isnan({c}) AND {ok}, false)
AND EXISTS (SELECT 1 FROM pista_candidata d WHERE d.artista_id = p.artista_id AND d.id <> p.id AND coalesce(NOT isnan(d.{c}) AND {ok.replace(c, "d." + c)}, false))"""
    for c, ok in _OK.items()
)


@query(_CASE)
def p2_found(t: Tables) -> DataFrame:
    """The cells filled from the same artist."""
    return fill_tracks(t.pista_candidata, LEVELS[:1]).filter("nivel = 'artista'").select(F.col("id").alias("pista_id"), "campo").distinct()


_LONG = " UNION ALL ".join(f"SELECT id, artista_id, album_id, analizado_en AS t, '{c}' AS campo, CASE WHEN NOT isnan({c}) AND {ok} THEN CAST({c} AS VARCHAR) END AS v FROM pista_candidata" for c, ok in _OK.items())


def _level(name: str, rank: int, group: str, sort: str) -> str:
    """The fillings of one level in SQL."""
    where = f"WHERE {group} IS NOT NULL" if group else ""
    part = f"PARTITION BY campo{', ' + group if group else ''} ORDER BY {sort + ' NULLS LAST, ' if sort else ''}t NULLS LAST, id"
    donor = "CASE WHEN v IS NOT NULL THEN {'id': id, 't': t, 's': " + (sort or "0") + ", 'v': v} END"
    here = sort or "0"
    gap = lambda d: f"abs(epoch_us(t) - epoch_us({d}.t)) / 1e6"
    key = lambda d, side: f"({d}.s IS DISTINCT FROM {here})::INT, coalesce({gap(d)}, 'inf'::DOUBLE), {side}"
    return f"""SELECT id, campo, d.v AS valor, '{name}' AS nivel, d.id AS donante_id, {gap('d')} AS distancia_seg, {rank} AS r FROM (
 SELECT *, CASE WHEN n IS NULL OR (p IS NOT NULL AND ({key('p', 0)}) <= ({key('n', 1)})) THEN p ELSE n END AS d FROM (
  SELECT *, last_value({donor} IGNORE NULLS) OVER ({part} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p, first_value({donor} IGNORE NULLS) OVER ({part} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n FROM x {where})
 WHERE v IS NULL) WHERE d IS NOT NULL"""


_FILLED = f"""WITH x AS ({_LONG}), f AS ({_level('artista', 0, 'artista_id', 'album_id')} UNION ALL {_level('album', 1, 'album_id', '')} UNION ALL {_level('tiempo', 2, '', '')}),
b AS (SELECT *, row_number() OVER (PARTITION BY id, campo ORDER BY r) AS k FROM f)
SELECT x.id, x.campo, b.valor, b.id IS NOT NULL AS relleno, b.nivel, b.donante_id, b.distancia_seg FROM x LEFT JOIN b ON b.id = x.id AND b.campo = x.campo AND b.k = 1 WHERE x.v IS NULL"""


@query(_FILLED)
def p2_filled(t: Tables) -> DataFrame:
    """Every cell without a usable value, with its donor, the level it comes from and the distance in seconds."""
    return fill_tracks(t.pista_candidata)
