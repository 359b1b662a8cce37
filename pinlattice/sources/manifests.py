"""Checksums of file sets and manifests of datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pinlattice.operators.violations import explode_rules


def file_checksums(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(file, bytes, sha256) of every file below the folder ``path``; ``file`` is relative to it.

    Files are hashed in parallel, one row per file.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select(
        F.substring_index("path", path.rstrip("/") + "/", -1).alias("file"),
        F.col("length").alias("bytes"),
        F.sha2("content", 256).alias("sha256"),
    )


def fileset_digest(checksums: DataFrame) -> DataFrame:
    """One digest for a set of files, by a tree over the hashes of their names.

    A file's line is its digest and its name. Files whose name hashes agree in four hexadecimal
    digits share a leaf, the digest of its sorted lines; leaves that agree in two share a branch, and
    the root covers the 256 branches at most. So no task holds all lines, the value does not depend
    on how files are dealt over tasks, and a changed file changes three digests on its way up.
    """
    lines = checksums.select("bytes", F.sha2("file", 256).alias("__at"), F.concat_ws("  ", "sha256", "file").alias("__line"))

    def level(rows: DataFrame, digits: int) -> DataFrame:
        grouped = rows.groupBy(F.substring("__at", 1, digits).alias("__at")).agg(
            F.sum("files").alias("files"),
            F.sum("bytes").alias("bytes"),
            F.sha2(F.array_join(F.array_sort(F.collect_list("__line")), "\n"), 256).alias("digest"),
        )
        return grouped.withColumn("__line", F.concat_ws(" ", "__at", "digest"))

    branches = level(level(lines.withColumn("files", F.lit(1)), 4), 2)
    return branches.agg(
        F.coalesce(F.sum("files"), F.lit(0)).alias("files"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
        F.sha2(F.array_join(F.array_sort(F.collect_list("__line")), "\n"), 256).alias("digest"),
    )


def verify_frozen(manifest: DataFrame, checksums: DataFrame) -> DataFrame:
    """Violations of frozen artifacts (file, sha256) that are absent or changed."""
    actual = checksums.select("file", F.col("sha256").alias("__actual"))
    joined = manifest.join(actual, "file", "left")
    return explode_rules(
        joined,
        F.col("file"),
        {
            "missing_file": F.col("__actual").isNull(),
            "changed_file": F.col("__actual") != F.lower("sha256"),
        },
    )


def dataset_manifest(df: DataFrame, key: str = "experiment_id", outcome: str = "outcome") -> DataFrame:
    """One row about a dataset: rows, distinct ids, families, class counts."""
    per_id = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(outcome) == "pass").alias("passed")
    )
    families = df.select("family").distinct().agg(F.count(F.lit(1)).alias("families"))
    totals = per_id.agg(
        F.sum("n").alias("rows"),
        F.count(F.lit(1)).alias("distinct_ids"),
        F.sum("passed").alias("passed"),
        (F.sum("n") - F.sum("passed")).alias("failed"),
    )
    return totals.join(F.broadcast(families))
