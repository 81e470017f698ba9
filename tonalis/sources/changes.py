"""Changes to tables as new tables: upserts, indexing decisions, surrogate keys, cascades and ordered membership."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonalis.operators.library import number_rows


def upsert(old: DataFrame, new: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Rows of both, per key the one with the latest time; the new one on equal times."""
    rest = [c for c in old.columns if c not in keys]
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(time, "_new")).alias("_r")).select(*keys, *[f"_r.{c}" for c in rest])


def index_actions(incoming: DataFrame, library: DataFrame) -> DataFrame:
    """(ruta_archivo, accion): omitir (same content at the same path), actualizar (other content), rechazar (content known elsewhere), insertar."""
    here = library.select("ruta_archivo", F.col("hash_sha256").alias("_h")).distinct()
    known = library.filter(F.col("hash_sha256").isNotNull()).select("hash_sha256").distinct().withColumn("_known", F.lit(True))
    j = incoming.join(here, "ruta_archivo", "left").join(known, "hash_sha256", "left")
    there = F.col("_h").isNotNull() | F.col("_there")
    j = j.join(here.select("ruta_archivo").withColumn("_there", F.lit(True)), "ruta_archivo", "left").withColumn("_there", F.coalesce("_there", F.lit(False)))
    return j.select("ruta_archivo", F.when(there & F.col("_h").eqNullSafe(F.col("hash_sha256")), "omitir").when(there, "actualizar").when(F.col("_known"), "rechazar").otherwise("insertar").alias("accion"))


def assign_keys(rows: DataFrame, dimension: DataFrame, natural: list[str], key: str) -> DataFrame:
    """(natural..., key, nueva): the key of each natural key: the one it has, or the next free numbers in order."""
    wanted = rows.select(*natural).dropna().distinct()
    have = dimension.groupBy(*natural).agg(F.min(key).alias(key))
    new = number_rows(wanted.join(have.select(*natural), natural, "left_anti").withColumn("_g", F.lit(0)), ["_g"], [F.asc(c) for c in natural], "_n")
    top = dimension.agg(F.coalesce(F.max(key), F.lit(0))).scalar()
    fresh = new.withColumn("_top", top).select(*natural, (F.col("_top") + F.col("_n")).alias(key), F.lit(True).alias("nueva"))
    return wanted.join(have, natural).select(*natural, key, F.lit(False).alias("nueva")).unionByName(fresh)


def without(rows: DataFrame, removed: DataFrame, column: str, key: str) -> DataFrame:
    """Rows whose parent is not removed; rows without a parent stay."""
    return rows.join(removed.select(F.col(key).alias("_k")).filter("_k is not null"), F.col(column) == F.col("_k"), "left_anti")


def orphans(dimension: DataFrame, facts: DataFrame, key: str, column: str) -> DataFrame:
    """Entries of a dimension that no fact uses any more."""
    return without(dimension, facts, key, column)


def replace_members(items: DataFrame, group: str, item: str, position: str, cap: int) -> DataFrame:
    """Each item once at its first position, at most ``cap`` a group, renumbered from 1."""
    once = items.groupBy(group, item).agg(F.min(position).alias("_p"))
    return number_rows(once, [group], [F.asc("_p"), F.asc(item)]).filter(F.col("posicion") <= cap).select(group, item, "posicion")


def move(position: Column, source: int, target: int) -> Column:
    """Positions after the element at ``source`` moved to ``target``."""
    if source == target:
        return position
    lo, hi, step = (source + 1, target, -1) if source < target else (target, source - 1, 1)
    return F.when(position == source, target).when(position.between(lo, hi), position + step).otherwise(position)


def is_permutation(a: DataFrame, b: DataFrame) -> Column:
    """Whether two lists hold the same items equally often, as a scalar: neither has a row more."""
    return (a.exceptAll(b).agg(F.count("*")).scalar() == 0) & (b.exceptAll(a).agg(F.count("*")).scalar() == 0)


def parse_queue(queues: DataFrame, group: str, text: str) -> DataFrame:
    """(group, posicion, pista_id) of queues stored as comma-separated ids; what is no number is dropped."""
    e = queues.select(group, F.posexplode(F.split(F.col(text), ",")).alias("_p", "_t"))
    return e.select(group, (F.col("_p") + 1).alias("posicion"), F.trim("_t").try_cast("bigint").alias("pista_id")).filter("pista_id is not null")


def canonical_id() -> Column:
    """An identifier by precedence: recording, code, content, path."""
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return F.coalesce(F.concat(F.lit("mb:"), F.lower(blank("mb_recording_id"))), F.concat(F.lit("isrc:"), F.upper(blank("isrc"))), F.concat(F.lit("sha:"), F.lower(blank("hash_sha256"))), F.concat(F.lit("ruta:"), F.sha1("ruta_archivo")))


def next_index(index: Column, length: Column, repeat: str) -> Column:
    """The position after ``index`` in a queue: the same (one), around (all), or null past the end (none)."""
    if repeat == "one":
        return index
    step = index + 1
    return F.when(length <= 0, None).otherwise(F.pmod(step, length) if repeat == "all" else F.when(step < length, step))


def merged_entries(old: DataFrame, new: DataFrame, group: str, entry: str, time: str, sets: Sequence[str] = ()) -> DataFrame:
    """Manifests merged entry by entry: of each (group, entry) the later row of both sides, the new one on equal times; the array columns ``sets``
    become the union of both sides, sorted."""
    rest = [c for c in old.columns if c not in (group, entry, *sets)]
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    unions = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(F.col(c), F.array().cast("array<string>")))))).alias(c) for c in sets]  # at most two rows a key
    return both.groupBy(group, entry).agg(F.max_by(F.struct(*rest), F.struct(time, "_new")).alias("_r"), *unions).select(group, entry, *[f"_r.{c}" for c in rest], *sets)


def cascade(removed: DataFrame, key: str, children: dict[str, tuple[DataFrame, str]], version: int) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables without what belongs to removed rows, and their tombstones (entidad, entidad_id, version).

    ``children``: name -> (table, column that holds the key). Every table is one anti join; rows without a parent stay.
    """
    gone = removed.select(key).filter(F.col(key).isNotNull()).distinct()
    left = {name: without(df, gone, column, key) for name, (df, column) in children.items()}
    return left, gone.select(F.lit("pista").alias("entidad"), F.col(key).alias("entidad_id"), F.lit(version).cast("bigint").alias("version"))


def swap_in(df: DataFrame, path: str) -> None:
    """Replace the table at ``path`` whole: written beside it first, then renamed; readers see the old or the new table, and a failed write changes nothing."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    at, new, old = (jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + end) for end in ("", "._new", "._old"))
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    df.write.mode("overwrite").parquet(new.toString())
    fs.delete(old, True)
    if fs.exists(at):
        fs.rename(at, old)
    if not fs.rename(new, at):
        fs.rename(old, at)
        raise OSError(f"could not replace {path}")
    fs.delete(old, True)


def run_report(log: DataFrame, run: str, state: str, seconds: str) -> DataFrame:
    """(run, informe): a JSON report of each run: how many of each state, in all, and the seconds taken; what a sink of JSON lines writes."""
    per = log.groupBy(run, state).agg(F.count("*").alias("_n"), F.sum(seconds).alias("_s"))
    all_states = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce(state, F.lit("")).alias("k"), F.col("_n").alias("v")))))
    return per.groupBy(run).agg(all_states.alias("estados"), F.sum("_n").alias("total"), F.round(F.sum("_s"), 3).alias("segundos")).select(run, F.to_json(F.struct("total", "segundos", "estados")).alias("informe"))
