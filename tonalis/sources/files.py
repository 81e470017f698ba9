"""Files as rows: listing, validation, content digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonalis.materialise import task_count

#: Bytes read at a time.
PART = 1 << 20


def scan_files(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = True, content: bool = False) -> DataFrame:
    """(path, nombre, bytes, modificado[, content]) of the files under a folder; contents are only read if asked for. Empty files are not listed."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    out = df.select("path", F.substring_index("path", "/", -1).alias("nombre"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modificado"), *(["content"] if content else []))
    return out


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[A-Za-z0-9]+)$", 1))


def first_failure(rules: dict[str, Column]) -> Column:
    """The name of the first rule that a row breaks, or null: a cascade of conditions for valid rows."""
    out = F.lit(None).cast("string")
    for name, valid in reversed(rules.items()):
        out = F.when(~F.coalesce(valid, F.lit(False)), name).otherwise(out)
    return out


def _digest(batches: Iterable[pd.DataFrame], head: int, end: int) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    for batch in batches:
        out = []
        for path, size in zip(batch["path"], batch["bytes"].tolist()):
            system, place = fs.FileSystem.from_uri(path)
            whole, first, ends = hashlib.sha256(), hashlib.sha256(), hashlib.sha256()
            with system.open_input_file(place) as f:
                at = 0
                while data := f.read(PART):
                    whole.update(data)
                    first.update(data[: max(0, head - at)])
                    if size > 2 * end:
                        ends.update(data[: max(0, end - at)])
                    at += len(data)
                if size > 2 * end:
                    f.seek(size - end)
                    ends.update(f.read(end))
            out.append((path, size, whole.hexdigest(), first.hexdigest(), ends.hexdigest() if size > 2 * end else whole.hexdigest()))
        yield pd.DataFrame(out, columns=["path", "bytes", "entero", "cabeza", "extremos"])


def digests(files: DataFrame, head: int = 65_536, end: int = 524_288) -> DataFrame:
    """(path, bytes, entero, cabeza, extremos): SHA-256 of each whole file, of its first ``head`` bytes, and of its first and last
    ``end`` bytes (of the whole where these would overlap).

    ``files``: path and bytes. A file is read in parts of PART bytes on the executors and never becomes one value, however large.
    """
    spread = files.select("path", "bytes").repartition(task_count(files.sparkSession), "path")
    return spread.mapInPandas(lambda it: _digest(it, head, end), "path string, bytes long, entero string, cabeza string, extremos string")


def checksum_differences(left: DataFrame, right: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, estado): entries that are missing on one side or differ, of two lists of checksums."""
    a, b = left.select(key, F.col(digest).alias("_a")), right.select(key, F.col(digest).alias("_b"))
    state = F.when(F.col("_a").isNull(), "sobra").when(F.col("_b").isNull(), "falta").when(F.col("_a") != F.col("_b"), "distinto")
    return a.join(b, key, "full").select(key, state.alias("estado")).filter("estado is not null")
