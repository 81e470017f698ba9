"""Lineage cuts: a result is written once to the shared folder and read back as a plain table."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_RUN = uuid.uuid4().hex


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; only where that is unset (tests), a folder of this process.

    A machine-local folder is never used on a cluster: without the setting and without a local master it raises.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if "own" not in _OWN:
        _OWN["own"] = "file://" + tempfile.mkdtemp(prefix="tonalis-")
    return _OWN["own"]


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Unlike ``checkpoint()`` the rows are computed once only, stay columnar, and survive the loss of any executor.
    The caller may pass the result to :func:`discard` when nothing reads it any more.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tonalis-{_RUN}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tonalis_path = path
    _remember(spark)
    return out


def discard(df: DataFrame) -> None:
    """Delete what :func:`materialise` wrote for ``df``; a plain DataFrame is left alone."""
    path = getattr(df, "_tonalis_path", None)
    if path:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _remember(spark: SparkSession) -> None:
    if "hook" in _OWN:
        return
    _OWN["hook"] = "set"
    base = f"{shared_folder(spark)}/tonalis-{_RUN}"

    def clean() -> None:
        try:
            _delete(spark, base)
        except Exception:  # the session may already be gone
            if base.startswith("file:"):
                import shutil

                shutil.rmtree(base.removeprefix("file://").removeprefix("file:"), ignore_errors=True)

    atexit.register(clean)


def task_count(spark: SparkSession) -> int:
    """Tasks for a CPU-bound step: the session's shuffle partitions, at least two for every core."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Enough input partitions for a CPU-bound Python step.

    Large inputs already come in enough splits and are left as they are; only a small one is redistributed by ``keys``
    (which should be close to unique). ``df`` must be a plain scan: asking for the partitions of a plan with a shuffle runs it.
    """
    wanted = task_count(df.sparkSession)
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted, *keys)


