"""Appends, full rewrites, resumable loads and exports."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_rows(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append-only log."""
    df.write.mode("append").format(fmt).save(path)


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _published(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, data folder) of the published versions of a table, oldest first."""
    fs, folder = _filesystem(spark, f"{path.rstrip('/')}/_versions")
    if not fs.exists(folder):
        return []
    found = []
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if not name.isdigit():
            continue
        stream = fs.open(status.getPath())
        try:
            text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        # A pointer counts when its line is complete.
        if text.endswith("\n"):
            found.append((int(name), text.strip()))
    return sorted(found)


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The newest published version of a table that ``rewrite_table`` keeps."""
    versions = _published(spark, path)
    if not versions:
        raise FileNotFoundError(f"no published version of {path}")
    return spark.read.parquet(f"{path.rstrip('/')}/{versions[-1][1]}")


def rewrite_table(df: DataFrame, path: str, keep: int = 2) -> int:
    """Full rewrite as a new version; returns its number.

    The rows go to a folder of their own and count from the moment a pointer file of the next
    number is created, in one exclusive step: there is always a whole table to read, readers that
    have begun keep their version, a failed rewrite leaves the old one, and of two writers at the
    same number one fails. Nothing is renamed or copied. ``df`` may read from ``path``. The newest
    ``keep`` versions stay on disk.
    """
    spark, root = df.sparkSession, path.rstrip("/")
    before = _published(spark, root)
    number = before[-1][0] + 1 if before else 1
    folder = f"data-{number}-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{folder}")
    fs, pointer = _filesystem(spark, f"{root}/_versions/{number}")
    stream = fs.create(pointer, False)  # fails where the number is taken
    try:
        stream.write(bytearray(f"{folder}\n".encode()))
    finally:
        stream.close()
    for old, name in before[: max(len(before) + 1 - keep, 0)]:
        fs.delete(_filesystem(spark, f"{root}/_versions/{old}")[1], False)
        fs.delete(_filesystem(spark, f"{root}/{name}")[1], True)
    return number


def write_features(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """zstd Parquet or CSV export."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.option("compression", "zstd").parquet(path)


def write_shards(df: DataFrame, path: str) -> None:
    """One folder per shard; rows are clustered first so a shard is one file."""
    (
        df.repartition("shard_index")
        .sortWithinPartitions("shard_index", "matrix_order")
        .write.mode("overwrite")
        .partitionBy("shard_index")
        .json(path)
    )


def read_existing(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def resume_write(
    todo: DataFrame,
    path: str,
    key: Sequence[str],
    compute: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Compute and append only keys that are not stored yet; a rerun adds nothing.

    Returns the stored table. The anti-join runs before ``compute``, so the
    expensive part only sees missing keys.
    """
    spark = todo.sparkSession
    existing = read_existing(spark, path)
    # Of rows with one key the smallest by all other columns is kept.
    rest = [c for c in todo.columns if c not in key]
    least = todo.groupBy(*key).agg(F.min(F.struct(*rest)).alias("__r")) if rest else todo.distinct()
    missing = least.select(*key, "__r.*").select(*todo.columns) if rest else least
    if existing is not None:
        missing = missing.join(existing.select(*key), list(key), "left_anti")
    append_rows(compute(missing), path)
    return spark.read.parquet(path)
