"""Incremental exchange: versions, deltas, tombstones, keyset pages and merging by the last write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonalis.operators.library import number_rows


def version_of(time: Column) -> Column:
    """A version that rises with time: microseconds since 1970."""
    return F.unix_micros(time.cast("timestamp"))


def stamp(changes: DataFrame, order: list[Column], start: int = 0) -> DataFrame:
    """Consecutive versions in the order of arrival, after ``start``; numbered over pieces, not in one window."""
    return number_rows(changes.withColumn("_g", F.lit(0)), ["_g"], order, "_v").withColumn("version", F.col("_v") + start).drop("_g", "_v")


def delta(rows: DataFrame, version: str, since: Column | int) -> DataFrame:
    """Rows changed after a version; the condition reaches the scan."""
    return rows.filter(F.col(version) > since)


def entities(parts: dict[str, DataFrame]) -> DataFrame:
    """(entidad, entidad_id, version) of several tables (each id, version) as one change log."""
    out = None
    for name, df in parts.items():
        one = df.select(F.lit(name).alias("entidad"), F.col("id").alias("entidad_id"), "version")
        out = one if out is None else out.unionByName(one)
    return out


def page(log: DataFrame, since: int, limit: int, after: tuple[str, int] | None = None) -> DataFrame:
    """The next ``limit`` changes after a version, with ``hay_mas`` and where the next page begins: ``siguiente``, ``siguiente_entidad``
    and ``siguiente_id``, which the next call takes as ``since`` and ``after``. Changes of equal version are told apart by
    entity and id, so none is lost at the edge of a page.
    """
    later = F.col("version") > since
    if after is not None:
        later |= (F.col("version") == since) & ((F.col("entidad") > after[0]) | (F.col("entidad") == after[0]) & (F.col("entidad_id") > after[1]))
    top = log.filter(later).orderBy("version", "entidad", "entidad_id").limit(limit + 1)
    ranked = top.withColumn("_n", F.row_number().over(Window.orderBy("version", "entidad", "entidad_id")))  # limit + 1 rows
    whole = Window.partitionBy()
    out = ranked.withColumn("hay_mas", F.max("_n").over(whole) > limit).filter(F.col("_n") <= limit)
    last = F.max(F.struct("version", "entidad", "entidad_id")).over(whole)
    return out.withColumn("_last", last).select(*log.columns, "hay_mas", F.col("_last.version").alias("siguiente"), F.col("_last.entidad").alias("siguiente_entidad"), F.col("_last.entidad_id").alias("siguiente_id"))


def ordered_members(members: DataFrame, group: str, item: str, position: str) -> DataFrame:
    """(group, ids): the ids of each group as an array in order. The result has one row a group, so a group must fit a row."""
    return members.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct(position, item))), lambda s: s[item]).alias("ids"))


def latest(log: DataFrame, keys: list[str], time: str, tie: str, values: list[str]) -> DataFrame:
    """The last row of each key: an upsert over a log, as one aggregate."""
    return log.groupBy(*keys).agg(F.max(F.struct(time, tie, *values)).alias("_l")).select(*keys, f"_l.{time}", *[f"_l.{v}" for v in values])


def last_write_wins(local: DataFrame, remote: DataFrame, key: str, value: str, time: str) -> DataFrame:
    """Local values with those of the remote side that are strictly newer; remote rows without a time are ignored."""
    r = remote.filter(F.col(time).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.max(F.struct(time, value)).alias("_r"))
    j = local.join(r, F.col(key) == F.col("_k"), "left")
    newer = F.col("_r").isNotNull() & (F.col(time).isNull() | (F.col(f"_r.{time}") > F.col(time)))
    return j.select(key, F.when(newer, F.col(f"_r.{value}")).otherwise(F.col(value)).alias(value), F.when(newer, F.col(f"_r.{time}")).otherwise(F.col(time)).alias(time), newer.alias("remota"))


def closure(tracks: DataFrame, artists: list[int]) -> DataFrame:
    """(entidad, entidad_id): the tracks of a choice of artists with their albums and artists."""
    own = tracks.filter(F.col("artista_id").isin(artists))
    parts = [own.select(F.lit("pista").alias("entidad"), F.col("id").alias("entidad_id")), own.filter("album_id is not null").select(F.lit("album").alias("entidad"), F.col("album_id").alias("entidad_id")), own.select(F.lit("artista").alias("entidad"), F.col("artista_id").alias("entidad_id"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


def union_log(logs: list[DataFrame], key: list[str]) -> DataFrame:
    """Several append-only logs as one, each event once."""
    out = logs[0]
    for df in logs[1:]:
        out = out.unionByName(df)
    return out.dropDuplicates(key)


def active_since(events: DataFrame, who: str, time: str, days: int) -> DataFrame:
    """Who was seen in the last ``days`` days before the newest event."""
    last = events.agg(F.max(time)).scalar()
    return events.filter(F.col(time) >= last - F.expr(f"INTERVAL '{days}' DAY")).groupBy(who).agg(F.max(time).alias("visto"), F.count("*").alias("n"))


def playlist_closure(tracks: DataFrame, lists: DataFrame, members: DataFrame, chosen: list[int]) -> DataFrame:
    """(entidad, entidad_id): the chosen playlists, their tracks, and the albums and artists of these. ``members``: lista_id, pista_id."""
    ids = members.filter(F.col("lista_id").isin(chosen)).select(F.col("pista_id").alias("id")).distinct()
    own = tracks.join(ids, "id", "left_semi").select("id", "album_id", "artista_id")
    named = F.array(*[F.struct(F.lit(e).alias("entidad"), F.col(c).alias("entidad_id")) for e, c in (("pista", "id"), ("album", "album_id"), ("artista", "artista_id"))])
    things = own.select(F.explode(named).alias("x")).select("x.*").filter("entidad_id is not null")
    return things.unionByName(lists.filter(F.col("id").isin(chosen)).select(F.lit("lista").alias("entidad"), F.col("id").alias("entidad_id"))).distinct()


def manifest(log: DataFrame, since: int, newest: int) -> DataFrame:
    """(entidad, n, ultima, version_actual, recientes): what changed after a version, per entity, with its ``newest`` newest ids.

    ``version_actual`` is the last version of the whole log. Only the newest ids are ranked (group limit), no list of all is made.
    """
    changed = delta(log, "version", since)
    rank = F.row_number().over(Window.partitionBy("entidad").orderBy(F.desc("version"), "entidad_id"))
    few = changed.withColumn("_k", rank).filter(F.col("_k") <= newest).groupBy("entidad").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "entidad_id"))), lambda s: s["entidad_id"]).alias("recientes"))
    per = changed.groupBy("entidad").agg(F.count("*").alias("n"), F.max("version").alias("ultima"))
    now = log.agg(F.max("version")).scalar()
    return per.join(few, "entidad").select("entidad", "n", "ultima", now.alias("version_actual"), "recientes")


def toggled(rows: DataFrame, chosen: DataFrame, flag: str) -> DataFrame:
    """The rows (id, ``flag`` of 0 or 1, version) with the flag of the chosen ids switched and new versions after the last one, in the order of the ids."""
    last = rows.agg(F.max("version")).scalar()
    new = stamp(chosen.select("id").distinct(), [F.asc("id")], 0).select("id", F.col("version").alias("_k"))
    j = rows.join(new, "id", "left")
    return j.select("id", F.when(F.col("_k").isNull(), F.col(flag)).otherwise(1 - F.col(flag)).alias(flag), F.when(F.col("_k").isNull(), F.col("version")).otherwise(last + F.col("_k")).alias("version"))
