"""Batch recommendation: many requests at once, one plan, no loop over requests.

Environments are rows (env_id, python_version, package, version). Work that
depends only on releases (pair options of one current version) is done once per
distinct release pair and joined to the requests that need it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pinlattice.constants import (
    UNCOVERED_RELEASE,
    UNEMBEDDED_RELEASE,
    MAXIMUM_CANDIDATES,
    MAXIMUM_CHECKS,
    MAXIMUM_PINS,
    MAXIMUM_RECOMMENDATIONS,
    OPTIONS_PER_PACKAGE,
    PYTHON_VERSIONS,
)
from pinlattice.functions.names import canonical_name, environment_key, unordered_pair
from pinlattice.functions.requirements import blocking_clauses, constraints_allow, exact_pin, requirement_name
from pinlattice.functions.text import split_lines
from pinlattice.functions.versions import (
    history_key,
    is_pep440,
    padded_release,
    pep440_key,
    release_triple,
    triple_distance,
    version_distance,
)
from pinlattice.operators.ordered import attach
from pinlattice.operators.scoring import pair_risk
from pinlattice.operators.violations import explode_rules, union_all, violation
from pinlattice.session import materialize

CATEGORIES = (
    "achieves_requested_change",
    "keeps_current_version",
    "different_upgrade_fallback",
    "downgrade_fallback",
)


def parse_requirements(requests: DataFrame, text: str = "requirements_text") -> DataFrame:
    """(request_id, line, raw, package, version): comments and option lines are skipped."""
    lines = requests.select("request_id", F.posexplode(split_lines(F.col(text))).alias("line", "raw"))
    kept = lines.withColumn("raw", F.trim("raw")).filter(
        (F.col("raw") != "") & ~F.col("raw").rlike("^[#-]")
    )
    return kept.select(
        "request_id",
        "line",
        "raw",
        requirement_name(F.col("raw")).alias("package"),
        exact_pin(F.col("raw")).alias("version"),
    )


def validate_requests(requests: DataFrame, requirements: DataFrame) -> DataFrame:
    """Violations (rule, request, detail) of requests and their requirement rows.

    requests: request_id, python_version, target_package, requested_version.
    """
    per_request = requirements.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("pins"),
        F.count_if(F.col("version").isNull()).alias("unpinned"),
        F.count_if(~is_pep440(F.col("version"))).alias("invalid"),
    )
    repeated = (
        requirements.groupBy("request_id", "package")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
    )
    present = requirements.select(
        "request_id", F.col("package").alias("__target"), F.lit(True).alias("__p")
    ).distinct()
    checked = (
        requests.withColumn("__target", canonical_name(F.col("target_package")))
        .join(per_request, "request_id", "left")
        .join(present, ["request_id", "__target"], "left")
    )
    requested = F.trim(F.coalesce("requested_version", F.lit("")))
    return union_all(
        [
            explode_rules(
                checked,
                F.col("request_id"),
                {
                    "unsupported_python": ~F.coalesce(
                        F.trim("python_version").isin(*PYTHON_VERSIONS), F.lit(False)
                    ),
                    "no_requirements": F.col("pins").isNull(),
                    "too_many_pins": F.col("pins") > MAXIMUM_PINS,
                    "not_exactly_pinned": F.col("unpinned") > 0,
                    "invalid_pin_version": F.col("invalid") > 0,
                    "target_absent": F.col("pins").isNotNull() & F.col("__p").isNull(),
                    "requested_version_missing": requested == "",
                    "requested_version_invalid": (requested != "") & ~is_pep440(requested),
                },
            ),
            violation(repeated, "duplicate_package", F.col("request_id"), F.col("package")),
        ]
    )


def change_category(candidate: Column, requested: Column, current: Column) -> Column:
    """What picking ``candidate`` would mean for the requester."""

    def key(v: Column) -> Column:
        return F.coalesce(pep440_key(v), pep440_key(F.lit("0")))

    return (
        F.when(candidate == requested, CATEGORIES[0])
        .when(candidate == current, CATEGORIES[1])
        .when(current.isNotNull() & (key(candidate) < key(current)), CATEGORIES[3])
        .otherwise(CATEGORIES[2])
    )


def category_priority(category: Column) -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), category) - 1


def supported_families(features: DataFrame) -> DataFrame:
    """(lo, hi, python_version) of the unordered package pairs with feature rows."""
    lo, hi = unordered_pair(
        canonical_name(F.col("package_a_name")), canonical_name(F.col("package_b_name"))
    )
    return features.select(lo.alias("lo"), hi.alias("hi"), "python_version").distinct()


def environment_pairs(environments: DataFrame, families: DataFrame) -> DataFrame:
    """Supported package pairs of every environment, left name before right name.

    The family table drives the join, so unsupported combinations are never made.
    """
    left = environments.select(
        "env_id", "python_version", F.col("package").alias("lo"), F.col("version").alias("left_version")
    )
    right = environments.select(
        "env_id", F.col("package").alias("hi"), F.col("version").alias("right_version")
    )
    return (
        left.join(families, ["lo", "python_version"])
        .join(right, ["env_id", "hi"])
        .select(
            "env_id",
            "python_version",
            F.col("lo").alias("left"),
            "left_version",
            F.col("hi").alias("right"),
            "right_version",
        )
    )


def find_pair(pairs: DataFrame, features: DataFrame, how: str = "left", listed: str = "listed") -> DataFrame:
    """Exact feature row of an unordered pair as struct ``row`` (null when there is none).

    The row in the asked orientation is preferred, then the first listed one.
    """
    a, b = canonical_name(F.col("package_a_name")), canonical_name(F.col("package_b_name"))
    lo, hi = unordered_pair(a, b)
    forward = a == lo
    body = F.struct(*features.columns)
    index = features.groupBy(
        lo.alias("__lo"),
        hi.alias("__hi"),
        F.when(forward, F.col("package_a_version")).otherwise(F.col("package_b_version")).alias("__lov"),
        F.when(forward, F.col("package_b_version")).otherwise(F.col("package_a_version")).alias("__hiv"),
        F.col("python_version").alias("__python"),
    ).agg(
        F.min_by(F.when(forward, body), F.when(forward, F.col(listed))).alias("__forward"),
        F.min_by(F.when(~forward, body), F.when(~forward, F.col(listed))).alias("__backward"),
    )
    asked_lo = F.col("left") <= F.col("right")
    joined = pairs.join(
        index,
        (F.least("left", "right") == F.col("__lo"))
        & (F.greatest("left", "right") == F.col("__hi"))
        & (F.when(asked_lo, F.col("left_version")).otherwise(F.col("right_version")) == F.col("__lov"))
        & (F.when(asked_lo, F.col("right_version")).otherwise(F.col("left_version")) == F.col("__hiv"))
        & (F.col("python_version") == F.col("__python")),
        how,
    )
    row = F.when(asked_lo, F.coalesce("__forward", "__backward")).otherwise(
        F.coalesce("__backward", "__forward")
    )
    return joined.select(*pairs.columns, row.alias("row"))


def pair_rows(features: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Both orientations as (target, target_version, related, related_version), one pass."""

    def side(s: str, o: str) -> Column:
        return F.struct(
            canonical_name(F.col(f"package_{s}_name")).alias("target"),
            F.col(f"package_{s}_version").alias("target_version"),
            canonical_name(F.col(f"package_{o}_name")).alias("related"),
            F.col(f"package_{o}_version").alias("related_version"),
        )

    return features.select(
        F.explode(F.array(side("a", "b"), side("b", "a"))).alias("p"), "python_version", *keep
    ).select("p.*", "python_version", *keep)


def related_packages(requests: DataFrame, environments: DataFrame, families: DataFrame) -> DataFrame:
    """(request_id, python_version, target, related, current_version) of supported related packages."""
    wanted = requests.select(
        "request_id", "python_version", canonical_name(F.col("target_package")).alias("target")
    )
    installed = environments.select(
        F.col("env_id").alias("request_id"),
        F.col("package").alias("related"),
        F.col("version").alias("current_version"),
    )
    both = wanted.join(installed, "request_id").filter(F.col("related") != F.col("target"))
    lo, hi = unordered_pair(F.col("target"), F.col("related"))
    return both.withColumns({"lo": lo, "hi": hi}).join(
        families, ["lo", "hi", "python_version"], "left_semi"
    ).drop("lo", "hi")


def common_target_versions(related: DataFrame, oriented: DataFrame) -> DataFrame:
    """(request_id, target_version) available with every related package of the request."""
    versions = oriented.select("target", "related", "python_version", "target_version").distinct()
    wanted = related.groupBy("request_id").agg(F.count_distinct("related").alias("__n"))
    found = (
        related.join(versions, ["target", "related", "python_version"])
        .groupBy("request_id", "target_version")
        .agg(F.count_distinct("related").alias("__found"))
    )
    return (
        found.join(wanted, "request_id")
        .filter(F.col("__found") == F.col("__n"))
        .select("request_id", "target_version")
    )


GRAIN = ("python_version", "target", "related", "current_version")


def top_options(related: DataFrame, oriented: DataFrame, n: int = OPTIONS_PER_PACKAGE) -> DataFrame:
    """Best n allowed related versions per (target version, related package, current version).

    ``oriented`` has constraints_allow and structured_probability. Requests that
    share a current version share the options. The row-number limit is applied
    per task before the shuffle.
    """
    # Versions are parsed on each side before the join multiplies the rows.
    grains = related.select(*GRAIN).distinct().withColumn(
        "__current", release_triple(F.col("current_version"))
    )
    allowed = oriented.filter("constraints_allow").withColumn(
        "__related", release_triple(F.col("related_version"))
    )
    options = grains.join(allowed, ["python_version", "target", "related"]).select(
        *GRAIN,
        "target_version",
        "related_version",
        (F.col("related_version") != F.col("current_version")).alias("changed"),
        triple_distance(F.col("__related"), F.col("__current")).alias("distance"),
        F.col("structured_probability").alias("risk"),
    )
    window = W.partitionBy(*GRAIN, "target_version").orderBy(
        "changed", "distance", "risk", "related_version"
    )
    return options.withColumn("option", F.row_number().over(window)).filter(F.col("option") <= n)


def best_safe_option(related: DataFrame, oriented: DataFrame) -> DataFrame:
    """Single safe option per grain and target version: unchanged, then upgrades, then risk.

    ``oriented`` also has predicted_failure; predicted failures are no options.
    """
    grains = related.select(*GRAIN).distinct().withColumn(
        "__current", padded_release(F.col("current_version"), 3)
    )
    safe = oriented.filter(F.col("constraints_allow") & ~F.col("predicted_failure")).withColumn(
        "__option", padded_release(F.col("related_version"), 3)
    )
    option, current = F.col("__option"), F.col("__current")
    downgrade = option < current
    # Lowest upgrade first; among downgrades the newest one first.
    rank = F.struct(
        (F.col("related_version") != F.col("current_version")).alias("changed"),
        downgrade.alias("downgrade"),
        F.when(downgrade, F.transform(option, lambda x: -x)).otherwise(option).alias("order"),
        F.col("structured_probability").alias("risk"),
        F.col("related_version").alias("version"),
    )
    return (
        grains.join(safe, ["python_version", "target", "related"])
        .groupBy(*GRAIN, "target_version")
        .agg(
            F.min_by(
                F.struct("related_version", F.col("structured_probability").alias("risk")), rank
            ).alias("o")
        )
        .select(*GRAIN, "target_version", "o.related_version", "o.risk")
    )


def related_steps(related: DataFrame, options: DataFrame) -> DataFrame:
    """(request_id, target_version, steps, least_changes, least_risk) where every related package has options.

    An option that is listed twice counts once, with its higher risk. The least changes, and the risk
    of the safest candidate among those with the least changes, are known before anything is combined.
    A request has at most 99 related packages with a few options each, so the array is bounded.
    """
    return _steps(related, _grain_options(options))


def _grain_options(options: DataFrame) -> DataFrame:
    """(grain, target_version, options, least): one row for all requests that share the grain."""
    distinct = options.groupBy(*GRAIN, "target_version", "related_version").agg(
        F.min("option").alias("option"), F.max("changed").alias("changed"), F.max("risk").alias("risk")
    )
    return distinct.groupBy(*GRAIN, "target_version").agg(
        F.array_sort(F.collect_list(F.struct("option", "related_version", "changed", "risk"))).alias("options"),
        F.min(F.struct(F.col("changed").cast("int").alias("changed"), "risk")).alias("least"),
    )


def _steps(related: DataFrame, per_grain: DataFrame) -> DataFrame:
    wanted = related.groupBy("request_id").agg(F.count(F.lit(1)).alias("__n"))
    # Dealt out by request once: all that follows is per request.
    return (
        related.join(per_grain, list(GRAIN))
        .select("request_id", "target_version", "related", "options", "least")
        .repartition("request_id")
        .groupBy("request_id", "target_version")
        .agg(
            F.array_sort(F.collect_list(F.struct("related", "options"))).alias("steps"),
            F.sum("least.changed").cast("int").alias("least_changes"),
            F.greatest(F.max("least.risk"), F.lit(0.0)).alias("least_risk"),
        )
        .join(wanted, "request_id")
        .filter(F.size("steps") == F.col("__n"))
        .drop("__n")
    )


def expand_steps(grouped: DataFrame, beam: int = MAXIMUM_CANDIDATES) -> DataFrame:
    """Beam-limited product of the options of all steps; other columns of ``grouped`` stay."""
    state = "struct<changes:int,risk:double,versions:array<string>>"
    start = F.array(F.struct(F.lit(0), F.lit(0.0), F.array().cast("array<string>"))).cast(
        f"array<{state}>"
    )

    def expand(states: Column, step: Column) -> Column:
        grown = F.flatten(
            F.transform(
                states,
                lambda s: F.transform(
                    step["options"],
                    lambda o: F.struct(
                        (s["changes"] + o["changed"].cast("int")).alias("changes"),
                        F.greatest(s["risk"], o["risk"]).alias("risk"),
                        F.concat(s["versions"], F.array(o["related_version"])).alias("versions"),
                    ),
                ),
            )
        )
        # Fewest changes, lowest risk, then the versions in package order.
        return F.slice(F.array_sort(grown), 1, beam)

    # Most requests have one related package: its options are the candidates.
    only = F.get("steps", F.lit(0))["options"]
    alone = F.transform(
        only,
        lambda o: F.struct(
            o["changed"].cast("int").alias("changes"),
            F.greatest(F.lit(0.0), o["risk"]).alias("risk"),
            F.array(o["related_version"]).alias("versions"),
        ),
    ).cast(f"array<{state}>")
    single = (F.size("steps") == 1) & (F.size(only) <= beam)
    rest = [c for c in grouped.columns if c not in ("steps", "least_changes", "least_risk")]
    return grouped.select(
        *rest,
        F.transform("steps", lambda s: s["related"]).alias("packages"),
        F.explode(F.when(single, alone).otherwise(F.aggregate("steps", start, expand))).alias("s"),
    ).select(
        *rest,
        "packages",
        F.col("s.versions").alias("versions"),
        F.col("s.changes").alias("related_changes"),
        F.col("s.risk").alias("risk"),
    )


def expand_candidates(
    related: DataFrame, options: DataFrame, beam: int = MAXIMUM_CANDIDATES
) -> DataFrame:
    """All candidates: (request_id, target_version, packages, versions, related_changes, risk)."""
    return expand_steps(related_steps(related, options), beam)


def asked_changes(requests: DataFrame, environments: DataFrame) -> DataFrame:
    """(request_id, target, requested_version, current_target): the change a request asks for."""
    wanted = requests.select(
        "request_id", canonical_name(F.col("target_package")).alias("target"), "requested_version"
    )
    current = environments.select(
        F.col("env_id").alias("request_id"),
        F.col("package").alias("target"),
        F.col("version").alias("current_target"),
    )
    return wanted.join(current, ["request_id", "target"], "left")


_TRIPLE = ["target_version", "requested_version", "current_target"]


def compared_versions(triples: DataFrame) -> DataFrame:
    """What a change means, worked out once per distinct triple: many requests ask for the same change."""
    target, requested, current_version = (F.col(n) for n in _TRIPLE)
    return triples.select(*_TRIPLE).distinct().withColumns(
        {
            "category": change_category(target, requested, current_version),
            "distance": version_distance(target, requested),
            "__order": history_key(target),
        }
    ).withColumn("priority", category_priority(F.col("category")))


def with_target_change(rows: DataFrame, asked: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """Rows of (request_id, target_version) with what the change of the target itself means."""
    rows = rows.join(asked, "request_id")
    rows = attach(rows, compared_versions(rows) if changes is None else changes, _TRIPLE)
    return rows.withColumn("__moved", (~F.col("target_version").eqNullSafe(F.col("current_target"))).cast("int"))


# A table of no more changes is broadcast.
_FEW_CHANGES = 200_000
_BEST = ("priority", "changes", "risk", "distance", "__order")


def rank_candidates(
    candidates: DataFrame, requests: DataFrame, environments: DataFrame, limit: int = MAXIMUM_CANDIDATES
) -> DataFrame:
    """Candidates (one row per environment) by (category, changes, risk, version distance)."""
    rows = with_target_change(candidates, asked_changes(requests, environments))
    return _ranked(rows, limit)


def _ranked(rows: DataFrame, limit: int) -> DataFrame:
    rows = rows.withColumn("changes", F.col("related_changes") + F.col("__moved"))
    window = W.partitionBy("request_id").orderBy(*_BEST, "versions")
    ranked = rows.withColumn("position", F.row_number().over(window))
    return ranked.filter(F.col("position") <= limit).drop("__order", "__moved")


def best_candidates(
    related: DataFrame, options: DataFrame, requests: DataFrame, environments: DataFrame, limit: int = MAXIMUM_CANDIDATES
) -> DataFrame:
    """The first ``limit`` of ``rank_candidates`` without combining what cannot be among them.

    The best candidate of a target version is known from its options. A target version whose best
    candidate comes after ``limit`` others' best ones has none among the first ``limit``; ties stay.
    Only the rest is expanded. The options of a grain and the changes are made once; the triples of the
    changes come from the two sides, not from their product with the requests.
    """
    per_grain = materialize(_grain_options(options))
    asked = asked_changes(requests, environments).join(related.select("request_id").distinct(), "request_id", "left_semi")
    asked = materialize(asked)
    versions = per_grain.select(F.col("target").alias("__target"), "target_version").distinct()
    kinds = related.select("request_id", F.col("target").alias("__target")).distinct().join(asked, "request_id")
    kinds = kinds.select("__target", "requested_version", "current_target").distinct()
    changes = materialize(compared_versions(kinds.join(versions, "__target")))
    few = changes.limit(_FEW_CHANGES + 1).count() <= _FEW_CHANGES
    grouped = with_target_change(_steps(related, per_grain), asked, F.broadcast(changes) if few else changes)
    bounds = grouped.withColumns({"changes": F.col("least_changes") + F.col("__moved"), "risk": F.col("least_risk")})
    place = F.rank().over(W.partitionBy("request_id").orderBy(*_BEST))
    open_versions = bounds.withColumn("__place", place).filter(F.col("__place") <= limit).drop("__place", "changes", "risk")
    return _ranked(expand_steps(open_versions, limit), limit)


def candidate_environments(ranked: DataFrame, environments: DataFrame, checks: int = MAXIMUM_CHECKS) -> DataFrame:
    """Environment rows of the first ``checks`` candidates: env_id is request_id#position."""
    env_id = F.concat_ws("#", F.col("request_id").cast("string"), F.col("position").cast("string"))
    chosen = ranked.filter(F.col("position") <= checks).select(
        env_id.alias("candidate_id"),
        "request_id",
        F.map_from_arrays(
            F.concat(F.col("packages"), F.array("target")),
            F.concat(F.col("versions"), F.array("target_version")),
        ).alias("changed"),
    )
    base = environments.withColumnRenamed("env_id", "request_id")
    return base.join(chosen, "request_id").select(
        F.col("candidate_id").alias("env_id"),
        "request_id",
        "python_version",
        "package",
        F.coalesce(F.try_element_at("changed", F.col("package")), F.col("version")).alias("version"),
    )


def environment_keys(environments: DataFrame) -> DataFrame:
    """(env_id, environment_key): digest of the sorted pins of an environment (at most 100)."""
    return environments.groupBy("env_id").agg(
        environment_key(F.collect_list(F.struct(F.col("package").alias("name"), "version"))).alias(
            "environment_key"
        )
    )


def join_resolution(environments: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(env_id, environment_key, resolvable): an unknown verdict stays null.

    verdicts: environment_key, resolvable.
    """
    return environment_keys(environments).join(verdicts, "environment_key", "left")


def with_constraints(features: DataFrame) -> DataFrame:
    return features.withColumn(
        "constraints_allow",
        constraints_allow(
            F.col("package_a_declares_package_b"),
            F.col("package_a_requirement_allows_b"),
            F.col("package_b_declares_package_a"),
            F.col("package_b_requirement_allows_a"),
        ),
    )


def constraint_conflicts(features: DataFrame) -> DataFrame:
    """One row per violated direction with the clauses that block."""
    no = F.lit(False)

    def direction(s: str, o: str) -> Column:
        declared = F.coalesce(F.col(f"package_{s}_declares_package_{o}"), no)
        allowed = F.coalesce(F.col(f"package_{s}_requirement_allows_{o}"), no)
        requirement = F.trim(
            F.get(F.split(F.coalesce(f"package_{s}_requirement_on_{o}", F.lit("")), ";", 2), F.lit(0))
        )
        version = F.col(f"package_{o}_version")
        return F.when(
            declared & ~allowed,
            F.struct(
                canonical_name(F.col(f"package_{s}_name")).alias("declaring_package"),
                F.col(f"package_{s}_version").alias("declaring_version"),
                canonical_name(F.col(f"package_{o}_name")).alias("dependency_package"),
                version.alias("dependency_version"),
                requirement.alias("requirement"),
                blocking_clauses(requirement, version).alias("blocking_specifiers"),
            ),
        )

    return features.select(
        "experiment_id",
        F.explode(F.array_compact(F.array(direction("a", "b"), direction("b", "a")))).alias("c"),
    ).select("experiment_id", "c.*")


SCORES = (
    "constraints_allow",
    "structured_probability",
    "import_probability",
    "smoke_probability",
    "combined_probability",
    "risk_detected",
)


def assess_pairs(environments: DataFrame, scored: DataFrame, resolved: DataFrame) -> DataFrame:
    """Risk rows of all supported pairs of environments.

    ``scored``: feature rows with constraints_allow, structured_probability, the
    post-install columns and ``listed``. ``resolved`` has (env_id, resolvable):
    post-install scores count only where the environment resolved. A pair
    without a feature row has covered = false.
    """
    pairs = environment_pairs(environments, supported_families(scored))
    found = find_pair(pairs, scored.select(*_key_columns(), *SCORES, "listed"))
    joined = found.join(resolved.select("env_id", "resolvable"), "env_id", "left")
    usable = F.col("row.constraints_allow") & F.coalesce("resolvable", F.lit(False))
    rows = joined.select(
        "env_id",
        "python_version",
        "left",
        "left_version",
        "right",
        "right_version",
        F.col("row").isNotNull().alias("covered"),
        (usable & F.col("row.combined_probability").isNull()).alias("embedding_missing"),
        "row.constraints_allow",
        "row.structured_probability",
        *[
            F.when(usable, F.col(f"row.{c}")).alias(c)
            for c in ("import_probability", "smoke_probability", "combined_probability", "risk_detected")
        ],
    )
    return pair_risk(rows)


def _key_columns() -> list[str]:
    return [
        "package_a_name",
        "package_a_version",
        "package_b_name",
        "package_b_version",
        "python_version",
    ]


def environment_risk(pairs: DataFrame) -> DataFrame:
    """One row per environment of its pair risks; warnings are the pairs without coverage.

    ``distinct_warnings`` lists each warning text once (at most one per pair of pins).
    """
    conflict = F.coalesce(~F.col("constraints_allow"), F.lit(False))
    warned = ~F.col("covered") | F.coalesce("embedding_missing", F.lit(False))
    return pairs.groupBy("env_id").agg(
        F.count(F.lit(1)).alias("pairs"),
        F.max("combined_probability").alias("maximum_post_install_risk"),
        F.count("combined_probability").alias("covered_pairs"),
        F.max(conflict).alias("deterministic_conflicts"),
        F.max(F.coalesce("predicted_failure", F.lit(False))).alias("post_install_risk_detected"),
        F.count_if(warned).alias("warnings"),
        F.array_sort(F.collect_set(F.when(warned, coverage_warning()))).alias("distinct_warnings"),
    )


def coverage_warning() -> Column:
    """reason|release|release|python of a pair without a post-install score."""
    reason = F.when(F.col("covered"), UNEMBEDDED_RELEASE).otherwise(UNCOVERED_RELEASE)
    left, right = F.concat("left", F.lit("=="), "left_version"), F.concat("right", F.lit("=="), "right_version")
    return F.concat_ws("|", reason, left, right, "python_version")


def pair_risk_order(pairs: DataFrame) -> DataFrame:
    """Covered pairs of each environment by falling risk (position 1 is the riskiest)."""
    window = W.partitionBy("env_id").orderBy(F.col("risk_score").desc(), "left", "right")
    return pairs.filter("covered").withColumn("position", F.row_number().over(window))


def advice_status(environments: DataFrame) -> DataFrame:
    """Ordered status of (resolvable, environment risk) rows."""
    return environments.withColumn(
        "status",
        F.when(F.col("resolvable").isNull(), "resolver_unavailable")
        .when(
            ~F.col("resolvable")
            | F.coalesce("deterministic_conflicts", F.lit(False))
            | F.coalesce("post_install_risk_detected", F.lit(False)),
            "risk_found",
        )
        .when(F.coalesce("covered_pairs", F.lit(0)) < 1, "coverage_unavailable")
        .otherwise("no_risk_predicted"),
    )


def recommend(
    ranked: DataFrame,
    assessments: DataFrame,
    checks: int = MAXIMUM_CHECKS,
    limit: int = MAXIMUM_RECOMMENDATIONS,
) -> DataFrame:
    """First ``limit`` accepted candidates among the first ``checks`` per request.

    The slice of checks is taken before conflicts are dropped, so a conflicting
    candidate uses up a check. ``assessments``: request_id, position,
    deterministic_conflicts, resolvable, covered_pairs,
    post_install_risk_detected, warnings, maximum_post_install_risk.
    """
    sliced = ranked.filter(F.col("position") <= checks)
    joined = sliced.join(assessments, ["request_id", "position"])
    accepted = joined.filter(
        ~F.col("deterministic_conflicts")
        & F.coalesce("resolvable", F.lit(False))
        & (F.col("covered_pairs") >= 1)
        & ~F.col("post_install_risk_detected")
        & (F.col("warnings") == 0)
    )
    window = W.partitionBy("request_id").orderBy("position")
    return accepted.withColumn("recommendation", F.row_number().over(window)).filter(
        F.col("recommendation") <= limit
    )


def recommendation_warning(requests: DataFrame, ranked: DataFrame, assessments: DataFrame, accepted: DataFrame) -> DataFrame:
    """Why a request got no recommendation, from counts of the checked verdicts."""
    considered = ranked.groupBy("request_id").agg(F.count(F.lit(1)).alias("considered"))
    checked = assessments.filter(~F.col("deterministic_conflicts")).groupBy("request_id").agg(
        F.count_if(F.col("resolvable").isNull()).alias("unavailable"),
        F.count_if(~F.col("resolvable")).alias("rejected"),
        F.count_if("resolvable").alias("resolved"),
    )
    chosen = accepted.groupBy("request_id").agg(F.count(F.lit(1)).alias("accepted"))
    rows = requests.select("request_id")
    for table in (considered, checked, chosen):
        rows = attach(rows, table, ["request_id"], "left")
    rows = rows.na.fill(0)
    return rows.withColumn(
        "warning",
        F.when((F.col("accepted") > 0) | (F.col("considered") == 0), F.lit(None).cast("string"))
        .when((F.col("unavailable") > 0) & (F.col("resolved") == 0), "verdicts_unavailable")
        .when((F.col("rejected") > 0) & (F.col("resolved") == 0), "all_rejected")
        .when(F.col("resolved") > 0, "removed_by_risk_policy")
        .otherwise("none_checked"),
    )


def top_alternatives(candidates: DataFrame, n: int = MAXIMUM_RECOMMENDATIONS) -> DataFrame:
    """By (category, changes, maximum risk, version distance)."""
    window = W.partitionBy("request_id").orderBy(
        "priority", "changes", "maximum_risk_score", "distance", "target_version"
    )
    return candidates.withColumn("position", F.row_number().over(window)).filter(
        F.col("position") <= n
    )


def advise(
    requests: DataFrame, environments: DataFrame, scored: DataFrame, verdicts: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(status per request, recommendations, warnings, violations) for a batch of requests.

    ``environments`` are the current pins (env_id = request_id). Requests that break a rule (no more
    than the allowed number of pins, exact versions, a supported target) are reported as violations and
    get no advice. The proposed environment replaces the target's version by the requested one.
    """
    pins = environments.select(F.col("env_id").alias("request_id"), "package", "version")
    problems = materialize(validate_requests(requests, pins))
    broken = problems.select(F.col("key").alias("__key")).distinct()
    requests = materialize(requests.join(broken, F.col("request_id").cast("string") == F.col("__key"), "left_anti"))
    environments = environments.join(requests.select(F.col("request_id").alias("env_id")), "env_id", "left_semi")
    targets = requests.select(
        F.col("request_id").alias("env_id"),
        canonical_name(F.col("target_package")).alias("package"),
        "requested_version",
    )
    proposed = environments.join(targets, ["env_id", "package"], "left").select(
        "env_id", "python_version", "package", F.coalesce("requested_version", "version").alias("version")
    )
    resolution = join_resolution(proposed, verdicts)
    risk = environment_risk(assess_pairs(proposed, scored, resolution))
    status = advice_status(resolution.join(risk, "env_id", "left"))

    families = supported_families(scored)
    related = materialize(related_packages(requests, environments, families))
    oriented = pair_rows(scored, ["constraints_allow", "structured_probability"])
    # At most 50 rows per request, read by four later steps.
    ranked = materialize(best_candidates(related, top_options(related, oriented), requests, environments))
    tried = candidate_environments(ranked, environments)
    tried_resolution = join_resolution(tried, verdicts)
    tried_risk = environment_risk(assess_pairs(tried, scored, tried_resolution))
    parts = F.split("env_id", "#")
    request_type = dict(requests.dtypes)["request_id"]
    assessments = materialize(
        tried_resolution.join(tried_risk, "env_id").select(
        F.get(parts, F.lit(0)).cast(request_type).alias("request_id"),
        F.get(parts, F.lit(1)).cast("int").alias("position"),
        "resolvable",
        "deterministic_conflicts",
        "covered_pairs",
        "post_install_risk_detected",
        "warnings",
        "maximum_post_install_risk",
        )
    )
    accepted = recommend(ranked, assessments)
    return status, accepted, recommendation_warning(requests, ranked, assessments, accepted), problems
