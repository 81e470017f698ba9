"""Sequential hot-deck: missing cells take the value of the nearest comparable record that has one."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonalis.materialise import materialise, task_count


def hot_deck(
    df: DataFrame,
    *,
    id_col: str,
    fields: Mapping[str, Column],
    levels: Sequence[tuple[str, str | None, Sequence[str]]],
    time: str,
) -> DataFrame:
    """One row per cell without a usable value, with the donor's value if a donor exists.

    ``fields`` maps each field to the condition under which its value is usable. ``levels`` are tried in order:
    (name, group column or None for the whole table, columns to sort by before ``time`` and ``id_col``). Within a group the
    records are sorted, and a cell takes the value of the nearest previous or next record with a usable one: first
    a donor that agrees on the sort columns, then the smaller distance in ``time``, then the previous one.

    Result: id, campo, valor (string form, fits every type), relleno (true if filled), nivel, donante_id, distancia_seg.
    A cell without any donor comes out with relleno false and the other columns null.

    Defined cases: a null group takes no part in that level; a null time sorts last and gives a null distance, which counts as
    the largest; equal times are ordered by id; repeated rows are each other's donors only if their ids differ (a row
    without a value has none to give); an empty table gives an empty result; further columns are ignored.

    Plan: only the needed columns are range-partitioned by (group, sort columns, time, id), so that a group of any size is cut
    over several tasks; windows run inside each piece, and the last and first donor of each piece are carried over to
    the other pieces of the same group by a join on (group, piece). No task ever holds a whole group.
    """
    names = list(fields)
    want = sorted({c for _, g, s in levels for c in [*s, *([g] if g else [])]} | {time})
    cells = df.select(F.col(id_col).alias("_id"), *[F.col(c).alias(f"_k_{c}") for c in want], *[F.when(fields[c], F.col(c).cast("string")).alias(f"_v_{c}") for c in names])
    parts = [_level(cells, names, f"_k_{g}" if g else None, [f"_k_{c}" for c in s], f"_k_{time}", name, k) for k, (name, g, s) in enumerate(levels)]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    missing = cells.select("_id", F.explode(F.filter(F.array(*[F.struct(F.lit(c).alias("campo"), F.col(f"_v_{c}").isNull().alias("falta")) for c in names]), lambda s: s["falta"])).alias("_c")).select("_id", F.col("_c.campo").alias("campo"), F.lit(None).cast("string").alias("valor"), F.lit(None).cast("string").alias("nivel"), F.lit(None).cast(dict(cells.dtypes)["_id"]).alias("donante_id"), F.lit(None).cast("double").alias("distancia_seg"), F.lit(len(levels)).alias("_rank"))
    # one row a cell and level: the best level wins; partial aggregation, no window over a hot key
    out = found.unionByName(missing).groupBy("_id", "campo").agg(F.min_by(F.struct("valor", "nivel", "donante_id", "distancia_seg"), "_rank").alias("_b"))
    return out.select(F.col("_id").alias(id_col), "campo", "_b.valor", F.col("_b.nivel").isNotNull().alias("relleno"), "_b.nivel", "_b.donante_id", "_b.distancia_seg")


def _level(cells: DataFrame, names: list[str], group: str | None, sort: list[str], time: str, level: str, rank: int) -> DataFrame:
    """(_id, campo, valor, nivel, donante_id, distancia_seg, _rank) of the cells that this level can fill."""
    spark = cells.sparkSession
    rows = cells if group is None else cells.filter(F.col(group).isNotNull())
    rows = rows.select(F.col(group) if group else F.lit(0).alias("_all"), *sort, time, "_id", *[f"_v_{c}" for c in names])
    group = group or "_all"
    keys = [F.col(group).asc(), *[F.col(c).asc_nulls_last() for c in sort], F.col(time).asc_nulls_last(), F.col("_id").asc()]
    cut = rows.repartitionByRange(task_count(spark), *keys).withColumn("_piece", F.spark_partition_id())
    cut = materialise(cut, f"deck{rank}")  # the pieces are read twice and must be the same both times
    donor = {c: F.when(F.col(f"_v_{c}").isNotNull(), F.struct(F.col("_id").alias("id"), F.col(time).alias("t"), F.struct(*sort).alias("s") if sort else F.lit(0).alias("s"), F.col(f"_v_{c}").alias("v"))) for c in names}
    cut = cut.select("*", *[donor[c].alias(f"_d_{c}") for c in names])
    key = F.struct(*[F.struct(F.col(c).isNull().alias("n"), F.col(c).alias("x")) for c in [*sort, time]], F.col("_id"))
    ends = cut.groupBy(group, "_piece").agg(*[f for c in names for f in (F.max_by(f"_d_{c}", F.when(F.col(f"_d_{c}").isNotNull(), key)).alias(f"_last_{c}"), F.min_by(f"_d_{c}", F.when(F.col(f"_d_{c}").isNotNull(), key)).alias(f"_first_{c}"))])
    # "next" is "previous" in the reverse order: a frame that only grows takes one pass, one that ends at the last row doesn't
    w = Window.partitionBy(group)  # a row a piece: at most as many as there are tasks
    before, after = (w.orderBy(o("_piece")).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc, F.desc))
    carry = ends.select(group, "_piece", *[f for c in names for f in (F.last(f"_last_{c}", True).over(before).alias(f"_cp_{c}"), F.last(f"_first_{c}", True).over(after).alias(f"_cn_{c}"))])
    inner = Window.partitionBy(group, "_piece")
    back = [*[F.col(c).desc_nulls_first() for c in [*sort, time]], F.col("_id").desc()]
    prev, nxt = (inner.orderBy(*o).rowsBetween(Window.unboundedPreceding, -1) for o in (keys[1:], back))
    near = cut.select(group, "_piece", "_id", time, *sort, *[f"_v_{c}" for c in names], *[f for c in names for f in (F.last(f"_d_{c}", True).over(prev).alias(f"_p_{c}"), F.last(f"_d_{c}", True).over(nxt).alias(f"_n_{c}"))])
    near = near.filter(F.greatest(*[F.col(f"_v_{c}").isNull().cast("int") for c in names], F.lit(0)) == 1)
    both = near.join(carry, [group, "_piece"], "left")
    here = F.struct(*sort) if sort else F.lit(0)

    def gap(d: Column) -> Column:
        return F.abs(F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(d["t"].cast("timestamp"))) / 1e6

    def pick(c: str) -> Column:
        p, n = F.coalesce(F.col(f"_p_{c}"), F.col(f"_cp_{c}")), F.coalesce(F.col(f"_n_{c}"), F.col(f"_cn_{c}"))
        far = F.lit(float("inf"))
        p_key = F.struct((~p["s"].eqNullSafe(here)).cast("int").alias("a"), F.coalesce(gap(p), far).alias("b"), F.lit(0).alias("c"))
        n_key = F.struct((~n["s"].eqNullSafe(here)).cast("int").alias("a"), F.coalesce(gap(n), far).alias("b"), F.lit(1).alias("c"))
        d = F.when(n.isNull() | (p.isNotNull() & (p_key <= n_key)), p).otherwise(n)
        return F.when(F.col(f"_v_{c}").isNull() & d.isNotNull(), F.struct(F.lit(c).alias("campo"), d["v"].alias("valor"), d["id"].alias("donante_id"), gap(d).alias("distancia_seg")))

    filled = both.select("_id", F.explode(F.array_compact(F.array(*[pick(c) for c in names]))).alias("_f"))
    return filled.select("_id", "_f.campo", "_f.valor", F.lit(level).alias("nivel"), "_f.donante_id", "_f.distancia_seg", F.lit(rank).alias("_rank"))


#: The ranges in which a measurement is usable (fixed values of the project).
USABLE = {"bpm": (0.0, 300.0), "energy": (0.0, 1.0), "mood_sad": (0.0, 1.0)}


def usable(field: str) -> Column:
    """Not null, not NaN and inside the field's range; the lower end counts except for ``bpm``."""
    low, high = USABLE[field]
    c = F.col(field)
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & (c > low if field == "bpm" else c >= low) & (c <= high), F.lit(False))


#: Where a donor is looked for, in this order.
LEVELS = (("artista", "artista_id", ("album_id",)), ("album", "album_id", ()), ("tiempo", None, ()))


def fill_tracks(tracks: DataFrame, levels: Sequence[tuple[str, str | None, Sequence[str]]] = LEVELS) -> DataFrame:
    """``bpm``, ``energy`` and ``mood_sad`` of ``pista_candidata``: from the same artist (album first, then time), else the
    same album, else the track analysed nearest in time."""
    return hot_deck(
        tracks,
        id_col="id",
        fields={c: usable(c) for c in USABLE},
        levels=levels,
        time="analizado_en",
    )
