"""Release catalog: release payloads, coverage, version ranks and version choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pinlattice.functions.binding import let
from pinlattice.functions.names import canonical_name
from pinlattice.functions.scalars import parse_time
from pinlattice.functions.versions import history_key, is_stable, pep440_stable, version_key
from pinlattice.functions.wheels import (
    coverage_reason,
    eligible_wheel_count,
    requires_python_allows,
    wheel_compatible,
    wheel_tags,
)
from pinlattice.operators.ordered import attach, exact_quantiles, ordered, with_scalars
from pinlattice.operators.violations import explode_rules, union_all


def _upload_time(file: Column) -> Column:
    return F.coalesce(
        F.nullif(file["upload_time_iso_8601"], F.lit("")), F.nullif(file["upload_time"], F.lit(""))
    )


def normalize_release(
    raw: DataFrame, pythons: Sequence[str], os: str = "linux", architecture: str = "x86_64"
) -> DataFrame:
    """Release payload (info, urls) x Python targets -> (python_version, release)."""
    info, python = F.col("info"), F.col("python_version")
    no = F.lit(False)
    allowed = F.col("__allowed")
    files = F.filter(
        F.col("urls"),
        lambda f: (f["packagetype"] == "bdist_wheel") & f["filename"].endswith(".whl"),
    )

    def wheel(f: Column) -> Column:
        parsed = F.struct(
            wheel_tags(f["filename"]).alias("tags"),
            wheel_compatible(f["filename"], python, os, architecture).alias("fit"),
        )
        return let(parsed, lambda x: described(f, x["tags"], x["fit"]))

    def described(f: Column, tags: Column, fit: Column) -> Column:
        return F.struct(
            f["filename"].alias("filename"),
            F.coalesce(f["url"], F.lit("")).alias("url"),
            f["size"].alias("size"),
            f["digests"]["sha256"].alias("sha256"),
            tags["python"].alias("python_tag"),
            tags["abi"].alias("abi_tag"),
            tags["platform"].alias("platform_tag"),
            ((tags["abi"] != "none") | (tags["platform"] != "any")).alias("has_native_extensions"),
            _upload_time(f).alias("uploaded_at"),
            F.coalesce(f["yanked"], no).alias("yanked"),
            (fit["compatible"] & allowed & ~F.coalesce(f["yanked"], no)).alias("compatible"),
            F.when(
                ~allowed,
                F.concat(
                    F.lit("Requires-Python "), info["requires_python"], F.lit(" excludes "), python
                ),
            )
            .otherwise(fit["reason"])
            .alias("compatibility_reason"),
        )

    empty = F.array().cast("array<string>")
    release = F.struct(
        info["name"].alias("name"),
        info["version"].alias("version"),
        info["requires_python"].alias("requires_python"),
        F.coalesce(info["requires_dist"], empty).alias("requires_dist"),
        F.coalesce(info["provides_extra"], empty).alias("extras"),
        F.coalesce(info["classifiers"], empty).alias("classifiers"),
        info["project_urls"].alias("project_urls"),
        F.array_min(F.array_compact(F.transform("urls", _upload_time))).alias("release_date"),
        F.coalesce(info["yanked"], no).alias("yanked"),
        F.coalesce(F.transform(files, wheel), F.array()).alias("wheels"),
    )
    targets = raw.withColumn(
        "python_version", F.explode(F.array(*[F.lit(p) for p in pythons]))
    )
    allows = requires_python_allows(info["requires_python"], python)
    return targets.withColumn("__allowed", allows).select(
        "python_version", release.alias("release")
    )


def explode_project_files(raw: DataFrame) -> DataFrame:
    """(package, version, file) rows of project payloads; a version without files keeps one row."""
    return raw.select(
        canonical_name(F.col("info.name")).alias("package"),
        F.explode("releases").alias("version", "files"),
    ).select("package", "version", F.explode_outer("files").alias("file"))


def read_ranking_rows(raw: DataFrame) -> DataFrame:
    """(project, download_count, listed) rows of ranking payloads without bad rows."""
    rows = raw.select(F.posexplode("rows").alias("listed", "row"))
    return rows.select("row.project", "row.download_count", "listed").filter(
        (F.trim(F.coalesce("project", F.lit(""))) != "") & (F.col("download_count") >= 0)
    )


def rank_projects(ranking: DataFrame) -> DataFrame:
    """Keep the first row per canonical name and number the rest 1..n."""
    named = ranking.select(
        canonical_name(F.col("project")).alias("package"), "download_count", "listed"
    )
    unique = named.groupBy("package").agg(
        F.min_by("download_count", "listed").alias("download_count"), F.min("listed").alias("listed")
    )
    return ordered(unique, [F.col("listed"), F.col("package")], position="rank").drop("listed")


def top_projects(ranked: DataFrame, versions: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(first n ranked projects with at least one eligible release, skipped projects)."""
    counts = versions.groupBy("package").agg(F.count(F.lit(1)).alias("releases"))
    selected = (
        ranked.join(counts, "package")
        .orderBy("rank")
        .limit(n)
        .withColumn("position", F.row_number().over(W.orderBy("rank")))
    )
    last = selected.agg(F.max("rank").alias("__last"))
    skipped = with_scalars(ranked.join(counts, "package", "left_anti"), last)
    return selected, skipped.filter(F.col("rank") < F.col("__last")).drop("__last")


def file_eligible(file: Column, cutoff: Column) -> Column:
    """Not yanked and uploaded at or before the cutoff."""
    return F.coalesce(
        ~F.coalesce(file["yanked"], F.lit(False)) & (parse_time(_upload_time(file)) <= cutoff),
        F.lit(False),
    )


def has_target_wheel(files: Column, pythons: Sequence[str], cutoff: Column) -> Column:
    """Some eligible wheel can be used with some Python target."""

    def usable(f: Column) -> Column:
        fits = F.lit(False)
        for p in pythons:
            fits = fits | (
                wheel_compatible(f["filename"], p)["compatible"]
                & requires_python_allows(f["requires_python"], p)
            )
        return f["filename"].endswith(".whl") & file_eligible(f, cutoff) & fits

    return F.coalesce(F.exists(files, usable), F.lit(False))


def eligible_versions(
    projects: DataFrame, pythons: Sequence[str], cutoff: Column
) -> DataFrame:
    """Stable versions (package, version) of project payloads with a usable wheel."""
    rows = projects.select(
        canonical_name(F.col("info.name")).alias("package"),
        F.explode("releases").alias("version", "files"),
    )
    return rows.filter(
        is_stable(F.col("version")) & has_target_wheel(F.col("files"), pythons, cutoff)
    ).select("package", "version")


def published_versions(projects: DataFrame, cutoff: Column) -> DataFrame:
    """Non-pre-release versions (package, version) with any file published by the cutoff."""
    rows = projects.select(
        canonical_name(F.col("info.name")).alias("package"),
        F.explode("releases").alias("version", "files"),
    )
    return rows.filter(
        pep440_stable(F.col("version")) & F.exists("files", lambda f: file_eligible(f, cutoff))
    ).select("package", "version")


def audit_scope(catalog: DataFrame) -> DataFrame:
    """Coverage row per (package, version, python_version) of a catalog.

    ``catalog`` has python_version and release (see ``normalize_release``).
    """
    r = F.col("release")
    count = eligible_wheel_count(r["wheels"])
    eligible = ~r["yanked"] & (count > 0)
    return catalog.select(
        canonical_name(r["name"]).alias("package"),
        r["version"].alias("version"),
        "python_version",
        eligible.alias("eligible"),
        coverage_reason(
            eligible,
            r["yanked"],
            r["requires_python"],
            F.col("python_version"),
            F.size(r["wheels"]),
            F.size(F.filter(r["wheels"], lambda w: w["yanked"])),
        ).alias("reason"),
        count.alias("compatible_wheels"),
    )


def coverage_summary(audited: DataFrame) -> DataFrame:
    releases = audited.groupBy("package", "version").agg(
        F.count(F.lit(1)).alias("targets"), F.count_if("eligible").alias("eligible")
    )
    packages = releases.groupBy("package").agg(
        F.count(F.lit(1)).alias("releases"),
        F.sum("targets").alias("targets"),
        F.sum("eligible").alias("eligible"),
    )
    return packages.agg(
        F.count(F.lit(1)).alias("packages"),
        F.sum("releases").alias("releases"),
        F.sum("targets").alias("python_targets"),
        F.sum("eligible").alias("eligible_targets"),
        (F.sum("targets") - F.sum("eligible")).alias("excluded_targets"),
    )


def exclusion_counts(audited: DataFrame) -> DataFrame:
    return (
        audited.filter(~F.col("eligible")).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))
    )


def release_rank(releases: DataFrame, key: Column | None = None) -> DataFrame:
    """0-based rank per package in version order, percentile and latest flag.

    ``releases`` may repeat (package, version), for example once per Python target.
    """
    key = history_key(F.col("version")) if key is None else key
    distinct = releases.select("package", "version").distinct().withColumn("__key", key)
    ranked = ordered(
        distinct,
        [F.col("__key"), F.col("version")],
        ["package"],
        position="__position",
        group_size="releases",
    )
    rank = F.col("__position") - 1
    return ranked.select(
        "package",
        "version",
        rank.alias("rank"),
        "releases",
        (rank / F.greatest(F.col("releases") - 1, F.lit(1))).alias("percentile"),
        (F.col("__position") == F.col("releases")).alias("is_latest"),
    )


def recent(releases: DataFrame, n: int) -> DataFrame:
    """Newest n versions per package.

    A row-number limit is pushed below the shuffle as a per-task limit, so a
    package with a long history sends at most n rows per task.
    """
    newest = W.partitionBy("package").orderBy(
        F.col("__key").desc(), F.col("version").desc()
    )
    return (
        releases.select("package", "version")
        .distinct()
        .withColumn("__key", history_key(F.col("version")))
        .withColumn("recency", F.row_number().over(newest))
        .filter(F.col("recency") <= n)
        .drop("__key")
    )


def _spread_ranks(n: int, size: Column) -> Column:
    """0-based ranks of n evenly spaced rows including both ends, half-even rounding."""
    if n == 1:
        return F.array(size - 1)
    return F.array(
        *[F.bround(F.lit(i) * (size - 1) / F.lit(n - 1)).cast("bigint") for i in range(n)]
    )


def spread_select(releases: DataFrame, n: int) -> DataFrame:
    """n evenly spaced versions per package; all of them when there are not more than n."""
    ranked = release_rank(releases)
    return ranked.filter(
        (F.col("releases") <= n)
        | F.array_contains(_spread_ranks(n, F.col("releases")), F.col("rank"))
    ).select("package", "version", "rank")


def select_versions(candidates: DataFrame, preserved: DataFrame, target: int) -> tuple[DataFrame, DataFrame]:
    """(selected versions, violations): keep preserved versions and fill up with the newest.

    A package without preserved versions gets an even spread instead. More
    preserved versions than the target is a violation.
    """
    pool = candidates.select("package", "version").distinct()
    kept = pool.join(preserved.select("package", "version").distinct(), ["package", "version"], "left_semi")
    flagged = pool.join(
        kept.withColumn("preserved", F.lit(True)), ["package", "version"], "left"
    ).withColumn("preserved", F.coalesce("preserved", F.lit(False)))
    counts = kept.groupBy("package").agg(F.count(F.lit(1)).alias("n_preserved"))
    ranked = ordered(
        flagged.withColumn("__key", history_key(F.col("version"))),
        [F.col("preserved"), F.col("__key"), F.col("version")],
        ["package"],
        position="__position",
        group_size="__size",
    )
    ranked = attach(ranked, counts, ["package"], "left")
    n_preserved = F.coalesce("n_preserved", F.lit(0))
    # Not preserved rows come first, so their 0-based rank is position - 1.
    remaining = F.col("__size") - n_preserved
    rank = F.col("__position") - 1
    added = (
        F.when(n_preserved > 0, rank >= remaining - (F.lit(target) - n_preserved))
        .when(remaining <= target, True)
        .otherwise(F.array_contains(_spread_ranks(target, remaining), rank))
    )
    selected = ranked.filter(F.col("preserved") | added).select("package", "version", "preserved")
    too_many = counts.filter(F.col("n_preserved") > target)
    problems = explode_rules(
        too_many, F.col("package"), {"preserved_exceed_target": F.lit(True)}
    )
    return selected.join(too_many.select("package"), "package", "left_anti"), problems


def union_versions(frames: Sequence[DataFrame]) -> DataFrame:
    return union_all([f.select("package", "version") for f in frames]).distinct()


def largest_histories(releases: DataFrame, n: int) -> DataFrame:
    counts = (
        releases.select("package", "version")
        .distinct()
        .groupBy("package")
        .agg(F.count(F.lit(1)).alias("releases"))
    )
    return counts.orderBy(F.col("releases").desc(), "package").limit(n)


def popularity_summary(releases: DataFrame) -> DataFrame:
    """Packages, releases and smallest, largest and lower-median history length."""
    counts = (
        releases.select("package", "version")
        .distinct()
        .groupBy("package")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    summary = counts.agg(
        F.count(F.lit(1)).alias("packages"),
        F.sum("n").alias("releases"),
        F.min("n").alias("min_releases"),
        F.max("n").alias("max_releases"),
    )
    return with_scalars(
        summary, exact_quantiles(counts, "n", {"median_releases": 0.5}, method="nearest")
    )


def catalog_consistency(catalog: DataFrame, key: Sequence[str], stable: Sequence[str]) -> DataFrame:
    """Keys whose stable fields differ between rows (for example between Python targets)."""
    digest = F.sha2(F.to_json(F.struct(*stable)), 256)
    return (
        catalog.select(*key, digest.alias("__d"))
        .groupBy(*key)
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.min("__d").alias("__lo"),
            F.max("__d").alias("__hi"),
        )
        .filter(F.col("__lo") != F.col("__hi"))
        .select(*key, "rows")
    )


def stable_order(version: str = "version") -> Column:
    return version_key(F.col(version))
