"""Observation log: resume, merge, repair, validation and audits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pinlattice.constants import (
    EVIDENCE_OUTCOMES,
    MEASURED_OUTCOMES,
    OBSERVATION_SCHEMA_VERSION,
    PYTHON_VERSIONS,
)
from pinlattice.functions.binding import let
from pinlattice.functions.names import canonical_name, experiment_id, parse_pin
from pinlattice.functions.outcomes import import_pattern
from pinlattice.operators.ordered import attach_by, exact_quantiles, with_scalars
from pinlattice.operators.violations import broken_rules, explode_rules, union_all, violation

INFRASTRUCTURE = "infrastructure_failure"


def _digest(df: DataFrame, exclude: Sequence[str] = ()) -> Column:
    return F.sha2(F.to_json(F.struct(*[c for c in df.columns if c not in exclude])), 256)


def first_wins(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the first row per key.

    The row-number filter is turned into a limit of one row per key and task before the shuffle, so a
    hot key is combined map-side; columns that nothing reads later are not moved.
    """
    place = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    return df.withColumn("__place", place).filter(F.col("__place") == 1).drop("__place")


def conflicts(df: DataFrame, key: Sequence[str], exclude: Sequence[str] = ()) -> DataFrame:
    """Keys that occur with different content."""
    digests = df.select(*key, _digest(df, [*key, *exclude]).alias("__d"))
    return (
        digests.groupBy(*key)
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.min("__d").alias("__lo"),
            F.max("__d").alias("__hi"),
        )
        .filter(F.col("__lo") != F.col("__hi"))
        .select(*key, "rows")
    )


def union_logs(
    logs: Sequence[DataFrame], key: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Concatenate logs; for a repeated key the earlier log wins, then ``order``."""
    numbered = [log.withColumn("__log", F.lit(i)) for i, log in enumerate(logs)]
    return first_wins(union_all(numbered), key, ["__log", *order]).drop("__log")


def pending(specs: DataFrame, results: DataFrame, key: str = "experiment_id") -> DataFrame:
    """Specs without a result; infrastructure failures do not count as results."""
    done = results.filter(F.col("outcome") != INFRASTRUCTURE).select(key)
    return specs.join(done, key, "left_anti")


def repair_results(df: DataFrame, key: str = "experiment_id") -> DataFrame:
    """Drop every row of a repeated key and lone infrastructure failures."""
    rest = [c for c in df.columns if c != key]
    grouped = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("__n"), F.any_value(F.struct(*rest)).alias("__row")
    )
    return (
        grouped.filter((F.col("__n") == 1) & (F.col("__row")["outcome"] != INFRASTRUCTURE))
        .select(key, *[F.col("__row")[c].alias(c) for c in rest])
        .select(*df.columns)
    )


def repair_summary(df: DataFrame, key: str = "experiment_id") -> DataFrame:
    grouped = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col("outcome") == INFRASTRUCTURE).alias("infra")
    )
    lone = (F.col("n") == 1) & F.col("infra")
    return grouped.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("input_rows"),
        F.count(F.lit(1)).alias("input_unique_ids"),
        F.count_if(F.col("n") > 1).alias("duplicate_ids"),
        F.count_if(lone).alias("infrastructure_only_ids"),
        F.count_if((F.col("n") == 1) & ~F.col("infra")).alias("output_rows"),
    )


def audit_ids(expected: DataFrame, actual: DataFrame, key: str = "experiment_id") -> DataFrame:
    """Rows (kind, key) for missing, extra and duplicate keys, from one shuffle."""
    tagged = expected.select(key, F.lit(1).alias("__e"), F.lit(0).alias("__a")).unionByName(
        actual.select(key, F.lit(0).alias("__e"), F.lit(1).alias("__a"))
    )
    counts = tagged.groupBy(key).agg(F.sum("__e").alias("__e"), F.sum("__a").alias("__a"))
    kinds = F.array_compact(
        F.array(
            F.when((F.col("__e") > 0) & (F.col("__a") == 0), "missing"),
            F.when((F.col("__e") == 0) & (F.col("__a") > 0), "extra"),
            F.when(F.col("__a") > 1, "duplicate"),
        )
    )
    return counts.select(F.explode(kinds).alias("kind"), key)


def seed_results(
    matrix: DataFrame,
    sources: Sequence[DataFrame],
    order: Sequence[str],
    existing: DataFrame | None = None,
    key: str = "experiment_id",
) -> tuple[DataFrame, DataFrame]:
    """(rows in matrix order columns, violations) for merging source logs into a matrix."""
    logs = [*sources, *([existing] if existing is not None else [])]
    everything = union_all(logs)
    problems = union_all(
        [
            violation(
                everything.join(matrix.select(key), key, "left_anti").select(key).distinct(),
                "outside_matrix",
                F.col(key),
            ),
            violation(conflicts(everything, [key]), "conflicting_rows", F.col(key)),
        ]
    )
    kept = union_logs(logs, [key], order)
    extra = [c for c in matrix.columns if c not in kept.columns]
    rows = kept.join(matrix.select(key, *extra), key)
    return rows, problems


def seed_summary(matrix: DataFrame, source: DataFrame, key: str = "experiment_id") -> DataFrame:
    per_key = source.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    joined = matrix.select(key).join(per_key, key, "left")
    return joined.agg(
        F.count(F.lit(1)).alias("matrix_experiments"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("source_rows"),
        F.count("n").alias("output_rows"),
        F.count_if(F.col("n").isNull()).alias("remaining"),
    )


def with_spec_id(df: DataFrame, name: str = "calculated_id") -> DataFrame:
    s = F.col("spec")
    return df.withColumn(
        name,
        experiment_id(
            s["package_a"]["name"],
            s["package_a"]["version"],
            s["package_b"]["name"],
            s["package_b"]["version"],
            s["python_version"],
            s["os"],
            s["architecture"],
        ),
    )


def result_rules() -> dict[str, Column]:
    """Rules of one result row that carries ``calculated_id``."""
    return {
        "missing_id": F.coalesce(F.col("experiment_id"), F.lit("")) == "",
        "id_mismatch": ~F.col("experiment_id").eqNullSafe(F.col("calculated_id")),
        "unmeasured_outcome": ~F.coalesce(
            F.col("outcome").isin(*MEASURED_OUTCOMES), F.lit(False)
        ),
        "not_measured": ~F.coalesce(F.col("measured"), F.lit(False)),
    }


def validate_results(df: DataFrame) -> DataFrame:
    checked = df if "calculated_id" in df.columns else with_spec_id(df)
    return explode_rules(checked, F.col("experiment_id"), result_rules())


def validate_manifest(df: DataFrame) -> DataFrame:
    """Rules of manifest rows (experiment_id, package_a, package_b, python, platform)."""
    a, b = parse_pin(F.col("package_a")), parse_pin(F.col("package_b"))
    rows = explode_rules(
        df,
        F.col("experiment_id"),
        {
            "invalid_pin": a.isNull() | b.isNull(),
            "same_package": canonical_name(a["name"]) == canonical_name(b["name"]),
            "unsupported_python": ~F.coalesce(
                F.col("python").isin(*PYTHON_VERSIONS), F.lit(False)
            ),
            "unsupported_platform": ~F.coalesce(
                F.col("platform").isin("linux_x86_64", "linux/x86_64"), F.lit(False)
            ),
        },
    )
    repeated = (
        df.groupBy("experiment_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    )
    empty = df.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == 0)
    return union_all(
        [
            rows,
            violation(repeated, "duplicate_id", F.col("experiment_id"), F.col("n")),
            violation(empty, "empty_manifest", F.lit("")),
        ]
    )


def outcome_counts(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows, failures, pass rate and failure percentage."""
    failed = (F.col("outcome") != "pass").cast("double")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("outcome") == "pass").alias("passed"),
        F.count_if(F.col("outcome") != "pass").alias("failed"),
        F.round(F.lit(1.0) - F.avg(failed), 6).alias("pass_rate"),
        F.round(F.avg(failed) * 100, 2).alias("failure_percent"),
    )


def outcomes_by(df: DataFrame, key: str) -> DataFrame:
    return (
        df.select(F.coalesce(F.col(key), F.lit("unknown")).alias(key), "outcome")
        .groupBy(key, "outcome")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def outcome_table(df: DataFrame, key: str, outcomes: Sequence[str]) -> DataFrame:
    """One column per outcome; the fixed value list avoids a job to discover it."""
    return (
        df.select(F.coalesce(F.col(key), F.lit("unknown")).alias(key), "outcome")
        .groupBy(key)
        .pivot("outcome", list(outcomes))
        .agg(F.count(F.lit(1)))
        .na.fill(0)
    )


def structural_audit(matrix: DataFrame, results: DataFrame) -> DataFrame:
    """One row that says whether a result log is valid and complete for a matrix.

    ``results`` needs experiment_id, outcome, measured and calculated_id (or spec).
    """
    results = results if "calculated_id" in results.columns else with_spec_id(results)
    tagged = matrix.select(
        "experiment_id",
        F.lit(1).alias("__e"),
        *[F.lit(0).alias(c) for c in ("__a", "__spec", "__infra", "__outcome", "__unmeasured")],
    ).unionByName(
        results.select(
            "experiment_id",
            F.lit(0).alias("__e"),
            F.lit(1).alias("__a"),
            (~F.col("experiment_id").eqNullSafe(F.col("calculated_id"))).cast("int").alias("__spec"),
            (F.col("outcome") == INFRASTRUCTURE).cast("int").alias("__infra"),
            (~F.col("outcome").isin(*MEASURED_OUTCOMES, INFRASTRUCTURE))
            .cast("int")
            .alias("__outcome"),
            (~F.coalesce(F.col("measured"), F.lit(False))).cast("int").alias("__unmeasured"),
        )
    )
    names = ["__e", "__a", "__spec", "__infra", "__outcome", "__unmeasured"]
    per_id = tagged.groupBy("experiment_id").agg(*[F.sum(n).alias(n) for n in names])
    expected, actual = F.col("__e") > 0, F.col("__a") > 0

    def total(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0))

    summary = per_id.agg(
        F.count_if(expected).alias("expected_experiments"),
        total("__a").alias("result_rows"),
        F.count_if(actual).alias("unique_result_ids"),
        F.count_if(F.col("__a") > 1).alias("duplicate_count"),
        F.count_if(expected & ~actual).alias("missing_count"),
        F.count_if(actual & ~expected).alias("extra_count"),
        total("__spec").alias("invalid_spec_count"),
        total("__infra").alias("infrastructure_failure_count"),
        total("__outcome").alias("invalid_outcome_count"),
        total("__unmeasured").alias("unmeasured_count"),
    )
    clean = F.lit(True)
    for name in (
        "duplicate_count",
        "extra_count",
        "invalid_spec_count",
        "infrastructure_failure_count",
        "invalid_outcome_count",
        "unmeasured_count",
    ):
        clean = clean & (F.col(name) == 0)
    return summary.withColumn("structural_valid", clean).withColumn(
        "complete",
        F.col("structural_valid")
        & (F.col("missing_count") == 0)
        & (F.col("result_rows") == F.col("expected_experiments")),
    )


def stage_exit(stages: Column, name: str) -> Column:
    """Exit code of the last stage with this name, null when it did not run."""
    found = F.filter(stages, lambda s: s["stage"] == name)
    return let(found, lambda f: F.get(f, F.size(f) - 1))["exit_code"]


def pins_of_artifacts(artifacts: Column) -> Column:
    return F.array_sort(
        F.array_distinct(
            F.transform(
                artifacts,
                lambda a: F.concat(canonical_name(a["package"]), F.lit("=="), a["version"]),
            )
        )
    )


def pins_of_environment(environment: Column) -> Column:
    pinned = F.filter(environment, lambda e: F.contains(e, F.lit("==")))
    pins = F.transform(
        pinned,
        lambda e: let(
            F.split(e, "==", 2),
            lambda p: F.concat(
                canonical_name(F.get(p, F.lit(0))), F.lit("=="), F.get(p, F.lit(1))
            ),
        ),
    )
    return F.array_sort(F.array_distinct(pins))


def environment_equals(artifacts: Column, environment: Column) -> Column:
    """Package to version maps are equal; maps have no equality, sorted pins do."""
    empty = F.array().cast("array<string>")
    return F.coalesce(pins_of_artifacts(artifacts), empty) == F.coalesce(
        pins_of_environment(environment), empty
    )


def top_level_equals(artifacts: Column, selected: Column) -> Column:
    """The two top-level artifacts are exactly the two selected wheels (name and hash)."""

    def keyed(wheels: Column) -> Column:
        return F.array_sort(
            F.transform(
                wheels, lambda w: F.concat_ws("|", w["filename"], F.lower(w["sha256"]))
            )
        )

    return F.coalesce(
        keyed(F.filter(artifacts, lambda a: F.coalesce(a["top_level"], F.lit(False))))
        == keyed(selected),
        F.lit(False),
    )


def fill_top_level_sizes(artifacts: Column, selected: Column) -> Column:
    """Artifacts whose missing sizes are taken from the audited wheel of that name."""

    def filled(a: Column) -> Column:
        audited = F.get(F.filter(selected, lambda w: w["filename"] == a["filename"]), F.lit(0))
        return a.withField("size", F.coalesce(a["size"], audited["size"]))

    return F.transform(artifacts, filled)


def evidence_rules() -> dict[str, Column]:
    """All row rules of the evidence audit, in order; needs ``in_matrix``."""
    no, outcome, stages = F.lit(False), F.col("outcome"), F.col("stages")
    artifacts, environment = F.col("installed_wheel_artifacts"), F.col("installed_environment")
    runtime, lock = F.col("runtime"), F.col("artifact_lock_sha256")
    resolution = outcome == "resolution_failure"
    resolve_exit = stage_exit(stages, "resolve_artifacts")
    smoke_exit = stage_exit(stages, "smoke_test")

    def holds(condition: Column) -> Column:
        return F.coalesce(condition, no)

    def size(array: Column) -> Column:
        return F.when(array.isNull(), F.lit(0)).otherwise(F.size(array))

    later = ~resolution
    rules = {
        "spec_absent_from_matrix": ~holds(F.col("in_matrix")),
        "schema_version": ~holds(F.col("schema_version") == OBSERVATION_SCHEMA_VERSION),
        "not_measured": ~holds(F.col("measured")),
        "cleanup_failed": ~holds(stage_exit(stages, "cleanup_environment") == 0),
        "top_level_wheels": size(F.col("wheel_artifacts")) != 2,
        "runtime_python": ~holds(
            runtime["python_version"].startswith(
                F.concat(F.col("spec")["python_version"], F.lit("."))
            )
        ),
        "runtime_platform": ~holds(
            (runtime["os"] == "linux") & runtime["architecture"].isin("x86_64", "amd64")
        ),
        "resolver_stage_did_not_fail": resolution & ~holds(resolve_exit != 0),
        "resolution_failure_has_evidence": resolution
        & ((size(artifacts) > 0) | (size(environment) > 0) | (F.coalesce(lock, F.lit("")) != "")),
        "unexpected_outcome": later & ~holds(outcome.isin(*EVIDENCE_OUTCOMES)),
    }
    for stage in ("resolve_artifacts", "install_exact_artifacts", "capture_environment"):
        rules[f"{stage}_failed"] = later & ~holds(stage_exit(stages, stage) == 0)
    hex64 = "^[0-9a-f]{64}$"
    rules |= {
        "lock_hash": later & ~holds(lock.rlike(hex64)),
        "top_level_artifacts": later
        & (size(F.filter(artifacts, lambda a: F.coalesce(a["top_level"], no))) != 2),
        "artifact_size": later
        & holds(F.exists(artifacts, lambda a: ~F.coalesce(a["size"] > 0, no))),
        "artifact_hash": later
        & holds(F.exists(artifacts, lambda a: ~F.coalesce(a["sha256"].rlike(hex64), no))),
        "environment_differs": later & ~environment_equals(artifacts, environment),
        "pass_without_smoke": (outcome == "pass") & ~holds(smoke_exit == 0),
        "failure_with_smoke_exit_zero": outcome.isin("import_failure", "smoke_test_failure")
        & holds(smoke_exit == 0),
    }
    return rules


def evidence_audit(matrix: DataFrame, results: DataFrame) -> DataFrame:
    """Rule violations of every result row; ``matrix`` needs experiment_id."""
    rules = evidence_rules()
    absent = rules.pop("spec_absent_from_matrix")
    # Rules of a row alone come first, so the join moves ids and rule names instead of whole rows.
    checked = with_spec_id(results).select("calculated_id", "experiment_id", broken_rules(rules).alias("__own"))
    known = matrix.select(
        F.col("experiment_id").alias("calculated_id"), F.lit(True).alias("in_matrix")
    ).distinct()
    broken = F.concat(broken_rules({"spec_absent_from_matrix": absent}), F.col("__own"))
    return checked.join(known, "calculated_id", "left").select(
        F.explode(broken).alias("rule"),
        F.col("experiment_id").cast("string").alias("key"),
        F.lit("").alias("detail"),
    )


def duration_stats(df: DataFrame, by: Sequence[str] = (), value: str = "duration_seconds") -> DataFrame:
    """Rows, total, median (mean of the middle two), 90th percentile (nearest rank), maximum."""
    totals = df.groupBy(*by).agg(
        F.count(value).alias("rows"),
        F.sum(value).alias("total_seconds"),
        F.max(value).alias("max_seconds"),
    )
    wanted = {"median_seconds": 0.5, "p90_seconds": (0.9, "nearest")}
    return attach_by(totals, exact_quantiles(df, value, wanted, by), by)


def resource_stats(df: DataFrame) -> DataFrame:
    r = F.col("resources")
    flat = df.select(
        r["peak_stage_rss_bytes"].alias("peak"),
        F.coalesce(r["host_network_received_change_bytes"], F.lit(0)).alias("received"),
        F.coalesce(r["host_network_transmitted_change_bytes"], F.lit(0)).alias("transmitted"),
        F.coalesce(r["cache_after"]["size_bytes"], F.lit(0)).alias("cache"),
    )
    sums = flat.agg(
        F.count("peak").alias("measured_rows"),
        F.max("peak").alias("max_rss_bytes"),
        F.sum("received").alias("network_received_bytes"),
        F.sum("transmitted").alias("network_transmitted_bytes"),
        F.max("cache").alias("max_cache_bytes"),
    )
    median = exact_quantiles(flat, "peak", {"median_rss_bytes": 0.5})
    return with_scalars(sums, median)


def runtime_identities(df: DataFrame) -> DataFrame:
    r = F.col("runtime")
    names = ("python_version", "kernel", "libc", "tool_version")
    return (
        df.select(*[F.coalesce(r[n], F.lit("None")).alias(n) for n in names])
        .groupBy(*names)
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def failure_patterns(df: DataFrame) -> DataFrame:
    """Counts (kind, value): import patterns, resolution failures by family, smoke exceptions.

    One scan: each row belongs to at most one kind.
    """
    outcome = F.col("outcome")
    kind = (
        F.when(outcome == "import_failure", "import_pattern")
        .when(outcome == "resolution_failure", "resolution_family")
        .when(outcome == "smoke_test_failure", "smoke_exception")
    )
    value = (
        F.when(outcome == "import_failure", import_pattern(F.col("normalized_error")))
        .when(outcome == "resolution_failure", F.coalesce(F.col("family"), F.lit("unknown")))
        .when(outcome == "smoke_test_failure", F.coalesce(F.col("exception_type"), F.lit("unknown")))
    )
    return (
        df.select(kind.alias("kind"), value.alias("value"))
        .filter(F.col("kind").isNotNull())
        .groupBy("kind", "value")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def artifact_columns(artifacts: Column, environment: Column) -> list[Column]:
    """Per-row evidence counts of installed artifacts."""
    native = F.filter(
        artifacts, lambda a: ~((a["abi_tag"] == "none") & (a["platform_tag"] == "any"))
    )

    def size(array: Column) -> Column:
        return F.when(array.isNull(), F.lit(0)).otherwise(F.size(array))

    return [
        size(environment).alias("installed_distribution_count"),
        size(artifacts).alias("installed_wheel_artifact_count"),
        F.greatest(size(artifacts) - 2, F.lit(0)).alias("transitive_distribution_count"),
        F.coalesce(
            F.aggregate(
                artifacts,
                F.lit(0).cast("bigint"),
                lambda s, a: s + F.coalesce(a["size"], F.lit(0).cast("bigint")),
            ),
            F.lit(0).cast("bigint"),
        ).alias("installed_wheel_bytes"),
        size(native).alias("installed_native_wheel_count"),
    ]


def artifact_stats(df: DataFrame) -> DataFrame:
    rows = df.select(
        *artifact_columns(F.col("installed_wheel_artifacts"), F.col("installed_environment")),
        F.coalesce(F.col("artifact_lock_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)).alias(
            "locked"
        ),
    )
    return rows.agg(
        F.sum("installed_wheel_artifact_count").alias("artifacts"),
        F.sum("transitive_distribution_count").alias("transitive_artifacts"),
        F.sum("installed_wheel_bytes").alias("wheel_bytes"),
        F.sum("installed_native_wheel_count").alias("native_artifacts"),
        F.count_if("locked").alias("locked_experiments"),
    )


def metric_deltas(pairs: Mapping[str, tuple[Column, Column]]) -> list[Column]:
    """after - before, null when either side is missing."""
    return [(after - before).alias(name) for name, (before, after) in pairs.items()]


def cache_effect(
    cold: DataFrame, warm: DataFrame, values: Sequence[str], key: str = "experiment_id"
) -> DataFrame:
    """Cold against warm measurements of the same experiment; keys must be unique per side."""
    c = cold.select(key, *[F.col(v).alias(f"cold_{v}") for v in values])
    w = warm.select(key, *[F.col(v).alias(f"warm_{v}") for v in values])
    joined = c.join(w, key, "full_outer")
    return joined.select(
        "*",
        *metric_deltas(
            {f"{v}_change": (F.col(f"cold_{v}"), F.col(f"warm_{v}")) for v in values}
        ),
    )


def reuse_summary(requested: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Counters of a resumed collection: requested, already there, still to do."""
    done = existing.select(key, F.lit(True).alias("__done")).distinct()
    return (
        requested.select(key)
        .join(done, key, "left")
        .agg(
            F.count(F.lit(1)).alias("requested"),
            F.count_if("__done").alias("skipped_existing"),
            F.count_if(F.col("__done").isNull()).alias("remaining"),
        )
    )
