"""Typed readers; every schema is given, nothing is inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pinlattice import schemas
from pinlattice.functions.names import canonical_name, experiment_id, parse_pin
from pinlattice.operators.catalog import read_ranking_rows
from pinlattice.operators.violations import union_all, violation
from pinlattice.sources.documents import read_sections

CORRUPT = "_corrupt_record"


def read_jsonl(spark: SparkSession, path: str, schema: str, missing_ok: bool = True) -> DataFrame:
    """Strict JSON lines: blank lines are skipped, a malformed line fails the job."""
    try:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    except AnalysisException as error:
        if missing_ok and error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected lines)."""
    rows = (
        spark.read.schema(f"{schema}, {CORRUPT} string")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path)
    )
    good = rows.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
    # A query over the corrupt column alone is not allowed, so the text is read for it.
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select(
        "value",
        F.from_json(
            "value", f"{schema}, {CORRUPT} string", {"columnNameOfCorruptRecord": CORRUPT}
        ).alias("row"),
    )
    bad = parsed.filter(F.col(f"row.{CORRUPT}").isNotNull() | F.col("row").isNull())
    return good, bad.select(F.col("value").alias("line"))


def _object(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def _parsed(text: str, schema: str) -> Column:
    return F.from_json(F.col(text), schema, {"mode": "FAILFAST"})


def read_scope(spark: SparkSession, path: str) -> DataFrame:
    """(package, role, split, version, version_order, python_version, eligible, reason, compatible_wheels).

    A version entry is an object or a bare string. Coverage is positional
    against ``coverage_order``; missing details get defaults.
    """
    packages = read_sections(spark, path).filter(F.col("section") == "packages")
    versions = packages.select(
        _parsed("members.coverage_order", "array<string>").alias("coverage_order"),
        F.col("name").alias("package"),
        _parsed("value", schemas.SCOPE_PACKAGE).alias("p"),
    ).select(
        "coverage_order",
        "package",
        "p.role",
        "p.split",
        F.posexplode("p.versions").alias("version_order", "entry"),
    )
    parsed = versions.withColumn(
        "v",
        F.when(
            F.ltrim("entry").startswith("{"), F.from_json("entry", schemas.SCOPE_VERSION)
        ).otherwise(
            F.from_json(
                F.to_json(F.struct(F.col("entry").alias("version"))), schemas.SCOPE_VERSION
            )
        ),
    )
    targets = parsed.select(
        "package", "role", "split", "version_order", "v",
        F.posexplode("coverage_order").alias("i", "python_version"),
    )
    eligible = F.get(F.col("v.coverage"), F.col("i"))
    detail = F.get(F.col("v.coverage_details"), F.col("i"))
    return targets.select(
        "package",
        "role",
        "split",
        F.col("v.version").alias("version"),
        "version_order",
        "python_version",
        eligible.alias("eligible"),
        F.coalesce(
            detail["reason"], F.when(eligible, "eligible").otherwise("not_covered")
        ).alias("reason"),
        F.coalesce(detail["compatible_wheels"], eligible.cast("int")).alias("compatible_wheels"),
    )


def scope_problems(spark: SparkSession, path: str) -> DataFrame:
    """Versions whose coverage does not align with coverage_order, and repeated versions."""
    rows = read_scope(spark, path)
    repeated = (
        rows.groupBy("package", "version", "python_version")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
    )
    key = F.concat_ws("==", "package", "version")
    return union_all(
        [
            violation(rows.filter(F.col("eligible").isNull()), "coverage_mismatch", key),
            violation(repeated, "duplicate_version", key),
        ]
    )


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(family, package_a, package_b, split, python_versions)."""
    families = read_sections(spark, path).filter(F.col("section") == "families")
    return families.select(
        _parsed("members.python_versions", "array<string>").alias("python_versions"),
        _parsed("value", schemas.FAMILY).alias("f"),
    ).select(
        F.col("f.name").alias("family"), "f.package_a", "f.package_b", "f.split", "python_versions"
    )


def read_plan(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(packages, families) of a dataset plan."""
    records = read_sections(spark, path)
    packages = records.filter(F.col("section") == "packages").select(
        F.col("members.minimum_versions_per_package").cast("int").alias("minimum_versions_per_package"),
        F.col("members.target_versions_per_package").cast("int").alias("target_versions"),
        F.col("name").alias("package"),
        _parsed("value", schemas.PLAN_PACKAGE).alias("p"),
    ).select(
        "package",
        "p.role",
        "p.split",
        F.coalesce("p.minimum_versions", "minimum_versions_per_package").alias("minimum_versions"),
        "target_versions",
    )
    families = records.filter(F.col("section") == "families").select(
        _parsed("value", schemas.FAMILY).alias("f")
    ).select(F.col("f.name").alias("family"), "f.package_a", "f.package_b", "f.split")
    return packages, families


def _specs(rows: DataFrame) -> DataFrame:
    a, b = parse_pin(F.col("e.package_a")), parse_pin(F.col("e.package_b"))
    return rows.select(
        *[c for c in rows.columns if c != "e"],
        experiment_id(a["name"], a["version"], b["name"], b["version"], F.col("e.python")).alias(
            "experiment_id"
        ),
        "e.family",
        "e.package_a",
        "e.package_b",
        "e.python",
        F.coalesce("e.platform", F.lit("linux_x86_64")).alias("platform"),
    )


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Typed experiments in manifest order (0-based ``position``)."""
    experiments = read_sections(spark, path).filter(F.col("section") == "experiments")
    return _specs(
        experiments.select(
            F.col("position").cast("int").alias("position"), _parsed("value", schemas.EXPERIMENT).alias("e")
        )
    )


def read_shard_dir(spark: SparkSession, path: str) -> DataFrame:
    """Union of shard manifests; order by (shard_index, position)."""
    shards = (
        spark.read.schema(schemas.MANIFEST)
        .option("multiLine", True)
        .option("mode", "FAILFAST")
        .json(path)
        .select("shard_index", "shard_count", "experiments", F.col("_metadata.file_name").alias("file"))
    )
    return _specs(
        shards.select(
            "shard_index", "shard_count", "file", F.posexplode("experiments").alias("position", "e")
        )
    )


def read_features_csv(
    spark: SparkSession, path: str, numeric: Sequence[str], text: Sequence[str]
) -> DataFrame:
    """CSV whose text columns stay text ("3.10" never becomes 3.1).

    The header decides the column order; columns outside both lists stay text.
    """
    header = spark.read.option("header", True).csv(path).columns
    schema = ", ".join(
        f"`{c}` {'double' if c in set(numeric) and c not in set(text) else 'string'}" for c in header
    )
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def read_ranking(spark: SparkSession, path: str) -> DataFrame:
    return read_ranking_rows(_object(spark, path, schemas.RAW_RANKING))


def load_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """Release vectors with canonical names; check them with ``embedding_problems``."""
    rows = read_jsonl(spark, path, schemas.EMBEDDING, missing_ok=False)
    return rows.withColumn("package", canonical_name(F.col("package")))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    rows = read_jsonl(spark, path, schemas.CATALOG)
    return rows.select(F.col("target.python_version").alias("python_version"), "release")


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, schemas.OBSERVATION)
