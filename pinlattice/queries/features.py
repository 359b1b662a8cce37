"""Feature tables over pairs derived from the order lines and releases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinlattice.constants import LABEL_COLUMNS, SIGNAL_PATTERNS
from pinlattice.operators.catalog import normalize_release
from pinlattice.constants import PYTHON_VERSIONS
from pinlattice.operators.texts import package_mentions, text_signals
from pinlattice.plans import features as ft
from pinlattice.plans.observation_flow import audited as audited_log
from pinlattice.plans.observation_flow import retry_list
from pinlattice.queries.adapters import Tables
from pinlattice.queries.aggregates import WORDS, duck_count, evidence_rows
from pinlattice.queries.projections import PYTHON_ROWS, payloads
from pinlattice.queries.registry import query
from pinlattice.session import materialize


def catalog_of(t: Tables) -> DataFrame:
    """Catalog with requirements on the next brand; stored once, as a catalog is."""
    raw = payloads(t)
    n = F.regexp_extract("info.name", r"(\d+)$", 1).cast("int")
    k = F.element_at(F.split("info.version", r"\."), 2).cast("int") % 4
    following = F.concat(F.lit("Brand_"), (n + 1).cast("string"))
    requirement = (
        F.when(k == 0, F.concat(following, F.lit(">=1.5")))
        .when(k == 1, F.concat(following, F.lit("<2,>0.2")))
        .when(k == 2, F.concat(following, F.lit("==3.*")))
    )
    declared = F.array_compact(F.array(F.lit("other>1"), requirement))
    info = F.col("info").withField("requires_dist", declared)
    return materialize(
        normalize_release(raw.withColumn("info", info), PYTHON_VERSIONS)
    )


def experiments_of(t: Tables) -> DataFrame:
    """One experiment per order line whose part has a successor brand.

    The second release is the one whose number is the supplier's, so every row has
    exactly one partner and no product is built.
    """
    releases = t.releases.select("release_id", "package", "version")
    a = releases.select(
        F.col("release_id").alias("a_id"), F.col("package").alias("package_a"), F.col("version").alias("version_a")
    )
    b = releases.select(
        F.col("release_id").alias("b_id"), F.col("package").alias("package_b"), F.col("version").alias("version_b")
    )
    lines = t.lineitem.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("experiment_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("matrix_order"),
        F.col("l_partkey").alias("a_id"),
        F.col("l_suppkey").alias("b_id"),
        F.element_at(F.array(*[F.lit(p) for p in PYTHON_VERSIONS]), (F.col("l_partkey") % 7 + 1).cast("int")).alias("python_version"),
        F.when(F.col("l_returnflag") == "R", "resolution_failure")
        .when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O"), "import_failure")
        .when((F.col("l_returnflag") == "N") & (F.col("l_quantity") < 25), "smoke_test_failure")
        .otherwise("pass")
        .alias("outcome"),
    )
    return lines.join(a, "a_id").join(b, "b_id").select(
        "experiment_id", "matrix_order", F.concat_ws("~", "package_a", "package_b").alias("family"),
        "package_a", "version_a", "package_b", "version_b", "python_version", "outcome",
    )


# Facts per release and Python target, then the pair, written out for DuckDB.
FACTS_SQL = f"""
g as (select package, version, max(requires_python) as rp from releases group by 1, 2),
w as (select r.*, g.rp, p.python_version, cast(substr(p.python_version, 3) as int) as m,
  epoch(cast(r.released as timestamp)) as up
  from releases r join g on r.package = g.package and r.version = g.version cross join {PYTHON_ROWS} p),
ok as (select *, not yanked and (rp is null or (rp = '>=3.9' and m >= 9) or (rp = '>=3.9,<3.12' and m between 9 and 11))
  and (filename like '%py3-none-any.whl' or filename like '%cp38-abi3-manylinux%' or (filename like '%cp311-cp311-manylinux%' and m = 11)) as fits from w),
f as (select package, version, python_version, max(rp) as rp, min(released) as released, min(filename) filter (where fits) as wheel,
  arg_min(release_id, (filename, release_id)) filter (where fits) as size_, count(*) filter (where fits) as wheels,
  cast(regexp_extract(package, '([0-9]+)$', 1) as int) as n, cast(split_part(version, '.', 1) as int) as v1, cast(split_part(version, '.', 2) as int) as v2,
  cast(split_part(version, '.', 3) as int) as v3 from ok group by 1, 2, 3),
e as (select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as experiment_id, a.package as package_a, a.version as version_a, b.package as package_b, b.version as version_b,
  concat('3.', cast(8 + l_partkey % 7 as varchar)) as python_version,
  case when l_returnflag = 'R' then 'resolution_failure' when l_returnflag = 'N' and l_linestatus = 'O' then 'import_failure'
    when l_returnflag = 'N' and l_quantity < 25 then 'smoke_test_failure' else 'pass' end as outcome
  from lineitem join releases a on a.release_id = l_partkey join releases b on b.release_id = l_suppkey),
p as (select e.*, a.n as an, b.n as bn, a.v1 as a1, a.v2 as a2, a.v3 as a3, b.v1 as b1, b.v2 as b2, b.v3 as b3, a.rp as arp, b.rp as brp, a.released as ar, b.released as br,
  a.wheel as aw, b.wheel as bw, a.wheels as ac, b.wheels as bc from e
  join f a on a.package = package_a and a.version = version_a and a.python_version = e.python_version
  join f b on b.package = package_b and b.version = version_b and b.python_version = e.python_version),
q as (select *, an + 1 = bn and a2 % 4 <> 3 as da, bn + 1 = an and b2 % 4 <> 3 as db,
  case when an + 1 = bn then case a2 % 4 when 0 then b1 * 1000 + b2 >= 1005 when 1 then b1 < 2 and (b1 * 1000 + b2 > 2 or (b1 = 0 and b2 = 2 and b3 > 0)) when 2 then b1 = 3 end end as aa,
  case when bn + 1 = an then case b2 % 4 when 0 then a1 * 1000 + a2 >= 1005 when 1 then a1 < 2 and (a1 * 1000 + a2 > 2 or (a1 = 0 and a2 = 2 and a3 > 0)) when 2 then a1 = 3 end end as ab from p)
"""


@query(
    "join_catalog",
    f"""
with {FACTS_SQL}
select package_a, package_b, python_version, count(*) as row_count, cast(sum(ac) as bigint) as a_wheels, cast(sum(bc) as bigint) as b_wheels, min(aw) as first_wheel from p group by all
""",
    "releases",
)
def _(t: Tables) -> DataFrame:
    rows, _ = ft.join_catalog(experiments_of(t), ft.release_facts(catalog_of(t)))
    return rows.groupBy("package_a", "package_b", "python_version").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum("a_eligible_wheel_count").alias("a_wheels"),
        F.sum("b_eligible_wheel_count").alias("b_wheels"),
        F.min("a_wheel_filename").alias("first_wheel"),
    )


FEATURE_SQL = """
experiment_id, package_a as package_a_name, package_b as package_b_name, cast(a1 as bigint) as package_a_version_major, cast(b3 as bigint) as package_b_version_patch,
  cast(substr(python_version, 3) as bigint) as python_minor, cast(abs(date_diff('day', ar, br)) as bigint) as release_date_distance_days,
  cast(date_diff('day', date '1970-01-01', ar) + 719163 as bigint) as package_a_release_ordinal,
  da as package_a_declares_package_b, db as package_b_declares_package_a, aa as package_a_requirement_allows_b, ab as package_b_requirement_allows_a,
  da and a2 % 4 = 1 as package_a_requirement_has_upper_bound, da and a2 % 4 in (0, 1) as package_a_requirement_has_lower_bound,
  da and a2 % 4 = 2 as package_a_requirement_has_exact_pin, cast(ac as int) as package_a_eligible_wheel_count, aw as package_a_wheel_filename,
  case when aw is null then null when aw like '%none-any.whl' then 'none' when aw like '%abi3%' then 'abi3' else 'cp311' end as package_a_wheel_abi_tag,
  coalesce(not aw like '%none-any.whl', false) as package_a_has_native_extensions,
  coalesce(not aw like '%none-any.whl', false) or coalesce(not bw like '%none-any.whl', false) as either_top_level_has_native_extensions
"""
FEATURE_COLUMNS = (
    "experiment_id",
    "package_a_name",
    "package_b_name",
    "package_a_version_major",
    "package_b_version_patch",
    "python_minor",
    "release_date_distance_days",
    "package_a_release_ordinal",
    "package_a_declares_package_b",
    "package_b_declares_package_a",
    "package_a_requirement_allows_b",
    "package_b_requirement_allows_a",
    "package_a_requirement_has_upper_bound",
    "package_a_requirement_has_lower_bound",
    "package_a_requirement_has_exact_pin",
    "package_a_eligible_wheel_count",
    "package_a_wheel_filename",
    "package_a_wheel_abi_tag",
    "package_a_has_native_extensions",
    "either_top_level_has_native_extensions",
)


@query(
    "feature_row",
    f"with {FACTS_SQL} select {FEATURE_SQL}, outcome, outcome <> 'pass' as is_failure from q",
    "releases",
)
def _(t: Tables) -> DataFrame:
    rows = ft.feature_row(experiments_of(t), ft.release_facts(catalog_of(t)))
    return rows.select(*FEATURE_COLUMNS, "outcome", "is_failure").withColumn(
        "package_a_release_ordinal", F.col("package_a_release_ordinal").cast("bigint")
    )


LARGE_SQL = f"""
with {FACTS_SQL},
k as (select package, version, row_number() over (partition by package order by v1, v2, v3) - 1 as rank, count(*) over (partition by package) as n from (select distinct package, version, v1, v2, v3 from f)),
x as (select q.*, ka.rank as ra, ka.n as na, coalesce(da and not aa, false) or coalesce(db and not ab, false) as blocked, (da and aa is not null) or (db and ab is not null) as known,
  coalesce(not aw like '%none-any.whl', false) as nat_a, coalesce(not bw like '%none-any.whl', false) as nat_b
  from q join k ka on ka.package = package_a and ka.version = version_a)
select experiment_id, ra as package_a_selected_version_rank, round(ra / greatest(na - 1, 1), 9) as package_a_selected_version_percentile, ra = na - 1 as package_a_is_latest_selected_version,
  cast(date_diff('day', ar, date '2026-07-25') as double) as package_a_release_age_days, blocked as published_constraint_blocked, known and not blocked as published_constraint_allows,
  not known as published_constraint_unknown, cast(da as int) + cast(db as int) as direct_dependency_edges, nat_a and nat_b as both_top_level_native, nat_a <> nat_b as exactly_one_top_level_native,
  coalesce(case when aw like '%none-any.whl' then 'any' when aw is not null then 'many' end, 'None') = coalesce(case when bw like '%none-any.whl' then 'any' when bw is not null then 'many' end, 'None') as wheel_platform_tags_match
from x
"""
LARGE_COLUMNS = (
    "experiment_id",
    "package_a_selected_version_rank",
    "package_a_selected_version_percentile",
    "package_a_is_latest_selected_version",
    "package_a_release_age_days",
    "published_constraint_blocked",
    "published_constraint_allows",
    "published_constraint_unknown",
    "direct_dependency_edges",
    "both_top_level_native",
    "exactly_one_top_level_native",
    "wheel_platform_tags_match",
)


@query("large_features", LARGE_SQL, "releases")
def _(t: Tables) -> DataFrame:
    frame = ft.large_features(experiments_of(t), catalog_of(t))
    return frame.select(*LARGE_COLUMNS).withColumn(
        "package_a_selected_version_percentile",
        F.round("package_a_selected_version_percentile", 9),
    )


@query("blind_inputs", LARGE_SQL, "releases")
def _(t: Tables) -> DataFrame:
    frame = ft.blind_inputs(experiments_of(t), catalog_of(t))
    assert not set(frame.columns) & set(LABEL_COLUMNS)
    ft.leakage_guard(ft.model_columns(frame), [frame])
    return frame.select(*LARGE_COLUMNS).withColumn(
        "package_a_selected_version_percentile",
        F.round("package_a_selected_version_percentile", 9),
    )


@query(
    "evidence_feature_row",
    """
with x as (select *, substr(sha256(concat_ws('|', concat('pkg-', cast(l_partkey as varchar)), concat(cast(l_linenumber as varchar), '.0'), concat('dep-', cast(l_suppkey as varchar)), '1.0',
    concat('3.', cast(8 + l_partkey % 7 as varchar)), 'linux', 'x86_64')), 1, 20) as experiment_id, l_returnflag = 'R' and l_linenumber <> 7 as res,
  case when l_linenumber = 7 then 'timeout' when l_returnflag = 'R' then 'resolution_failure' when l_returnflag = 'A' then 'pass' when l_linenumber % 2 = 0 then 'import_failure' else 'smoke_test_failure' end as outcome
  from lineitem),
r as (select *, row_number() over (partition by experiment_id order by l_orderkey, l_quantity, outcome) as rn from x)
select experiment_id, concat('pkg-', cast(l_partkey as varchar)) as package_a_name, outcome, case outcome when 'pass' then null when 'resolution_failure' then 'declared_dependency_resolution_conflict'
  when 'smoke_test_failure' then 'interoperability_behavior_failure' else 'other_failure' end as failure_category, outcome <> 'resolution_failure' as resolution_succeeded,
  case when res then 0 else 3 end as installed_wheel_artifact_count, case when res then 0 else 1 end as transitive_distribution_count, case when res then 0 else 1 end as installed_native_wheel_count,
  case when res then 0 else case when l_suppkey % 7 = 0 then 0 else l_partkey + 1 end + l_suppkey + 6 end as installed_wheel_bytes, l_quantity as duration_seconds,
  l_orderkey as cache_size_after_bytes, concat('6.', cast(l_suppkey % 4 as varchar)) as runtime_kernel
from r where rn = 1
""",
)
def _(t: Tables) -> DataFrame:
    """Packaged rows with post-run evidence: the catalog is made from the same lines."""
    results = evidence_rows(t)
    pins = F.array("spec.package_a", "spec.package_b")
    releases = results.select(F.explode(pins).alias("p"), F.col("spec.python_version").alias("python_version")).distinct()
    no_wheels = F.array().cast(
        "array<struct<filename:string,python_tag:string,abi_tag:string,platform_tag:string,size:bigint,"
        "has_native_extensions:boolean,yanked:boolean,compatible:boolean>>"
    )
    catalog = releases.select(
        "python_version",
        F.struct(
            "p.name",
            "p.version",
            F.lit(">=3.8").alias("requires_python"),
            F.array().cast("array<string>").alias("requires_dist"),
            F.lit("2024-01-01T00:00:00Z").alias("release_date"),
            no_wheels.alias("wheels"),
        ).alias("release"),
    )
    resources = F.col("resources")
    none = F.lit(None).cast("string")
    full = results.withColumn(
        "resources",
        resources.withField("cache_state_before", none)
        .withField("cache_before", F.struct(F.lit(None).cast("bigint").alias("size_bytes")))
        .withField(
            "machine_before",
            F.struct(F.lit(4).alias("cpu_count"), F.lit(8).cast("bigint").alias("memory_total_bytes")),
        ),
    ).withColumn("order", F.col("resources.cache_after.size_bytes"))
    matrix = evidence_ids(t).select(
        "experiment_id", F.lit("all").alias("family"), F.lit(1).alias("matrix_order")
    )
    rows = ft.evidence_feature_row(full, matrix, catalog, ["order", "duration_seconds", "outcome"])
    return rows.select(
        "experiment_id", "package_a_name", "outcome", "failure_category", "resolution_succeeded",
        "installed_wheel_artifact_count", "transitive_distribution_count",
        "installed_native_wheel_count", "installed_wheel_bytes", "duration_seconds",
        "cache_size_after_bytes", "runtime_kernel",
    )


def evidence_ids(t: Tables) -> DataFrame:
    return evidence_rows(t).select("experiment_id").distinct()


CHANGELOG_SQL = f"""
c as (select r.package, r.version, {WORDS} as w, length(trim(regexp_replace(text, '[\\s\\x0b\\x{{85}}\\p{{Z}}]+', ' ', 'g'))) as chars
  from (select package, version, min(release_id) as id from releases group by 1, 2) r join documents on doc_id = r.id),
d as (select package, version, chars, {duck_count(SIGNAL_PATTERNS["dependency"])} as dependency, {duck_count(SIGNAL_PATTERNS["breaking"])} > 0 as breaking,
  {duck_count(SIGNAL_PATTERNS["removal"])} > 0 as removal, {duck_count(SIGNAL_PATTERNS["abi"])} > 0 as abi from c)
"""


def changelog_of(t: Tables) -> DataFrame:
    """Signals of one note per release: the note whose number is the release's smallest id."""
    releases = t.releases.groupBy("package", "version").agg(F.min("release_id").alias("doc_id"))
    texts = releases.join(t.documents.select("doc_id", "text"), "doc_id")
    words = texts.select(
        F.explode(F.array(F.lit("license"), F.lit("brand-3"), F.lit("the"))).alias("name")
    ).distinct()
    mentions = package_mentions(texts, words, ["package", "version"])
    signals = text_signals(texts).withColumn("version_section_found", F.lit(True))
    return materialize(
        signals.drop("text", "evidence_lines", "doc_id").join(mentions, ["package", "version"])
    )


@query(
    "changelog_features",
    f"""
with {FACTS_SQL}, {CHANGELOG_SQL}
select experiment_id, cast(a.chars as int) as package_a_changelog_selected_characters, cast(b.dependency as int) as package_b_changelog_dependency_count,
  a.breaking or b.breaking as changelog_either_breaking_flag, (ar > br and (a.breaking or a.removal)) or (br > ar and (b.breaking or b.removal)) as changelog_newer_provider_break_risk,
  (a.abi and coalesce(not bw like '%none-any.whl', false)) or (b.abi and coalesce(not aw like '%none-any.whl', false)) as changelog_native_abi_risk, cast(0 as bigint) as changelog_pair_mentions
from q join d a on a.package = package_a and a.version = version_a join d b on b.package = package_b and b.version = version_b
""",
    "releases",
)
def _(t: Tables) -> DataFrame:
    frame = ft.feature_row(experiments_of(t), ft.release_facts(catalog_of(t)))
    rows, _ = ft.join_changelog(frame, changelog_of(t), strict=True)
    return ft.changelog_pair_features(rows).select(
        "experiment_id",
        "package_a_changelog_selected_characters",
        "package_b_changelog_dependency_count",
        "changelog_either_breaking_flag",
        "changelog_newer_provider_break_risk",
        "changelog_native_abi_risk",
        "changelog_pair_mentions",
    )


@query(
    "large_features_with_changelog",
    f"""
with {FACTS_SQL}, {CHANGELOG_SQL}
select experiment_id, a.package is not null as package_a_changelog_available, b.package is not null as package_b_changelog_available,
  cast(coalesce(a.chars, 0) as int) as package_a_changelog_selected_characters, coalesce(a.breaking, false) or coalesce(b.breaking, false) as changelog_either_breaking_flag
from q left join d a on a.package = package_a and a.version = version_a left join d b on b.package = package_b and b.version = version_b
""",
    "releases",
)
def _(t: Tables) -> DataFrame:
    frame = ft.large_features(experiments_of(t), catalog_of(t), changelog_of(t))
    return frame.select(
        "experiment_id",
        "package_a_changelog_available",
        "package_b_changelog_available",
        "package_a_changelog_selected_characters",
        "changelog_either_breaking_flag",
    )


@query("column_roles")
def _(t: Tables) -> DataFrame:
    """Data dictionary of the feature table with the filled rows of every column."""
    frame = ft.large_features(experiments_of(t), catalog_of(t))
    filled = frame.agg(*[F.count(c).alias(c) for c in frame.columns])
    long = filled.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("filled")) for c in filled.columns])
        ).alias("x")
    ).select("x.*")
    return ft.column_roles(frame).join(long, "column")


@query(
    "validate_feature_frames",
    """
with r as (select experiment_id, count(*) as n from observations group by 1),
c as (select 'audit_not_clean' as rule, '' as key union all
  select 'row_missing', m.experiment_id from matrix m left join r on r.experiment_id = m.experiment_id where r.n is null
  union all select 'row_extra', experiment_id from r where experiment_id not in (select experiment_id from matrix)
  union all select 'row_repeated', experiment_id from r where n > 1
  union all select 'shared_with_blind_set', experiment_id from observations where experiment_id in (select experiment_id from observations where family = 'family-3')
  union all select 'label_in_blind_set', 'outcome' union all select 'outcome_counts_differ', cast(count(*) filter (where outcome <> 'pass') as varchar) from observations)
select rule, count(*) as row_count, min(key) as first_key from c group by rule
""",
    "observations matrix",
)
def _(t: Tables) -> DataFrame:
    frame = t.observations.select("experiment_id", "family", "outcome")
    audit = frame.agg(
        (F.count(F.lit(1)) < 0).alias("structural_valid"),
        F.lit(True).alias("complete"),
        F.lit(-1).cast("bigint").alias("failed"),
    )
    problems = ft.validate_feature_frames(
        frame, t.matrix, audit, [frame.filter("family = 'family-3'")]
    )
    return problems.groupBy("rule").agg(
        F.count(F.lit(1)).alias("row_count"), F.min("key").alias("first_key")
    )


@query(
    "external_inputs",
    f"with {FACTS_SQL} select {FEATURE_SQL} from q where outcome = 'import_failure'",
    "releases",
)
def _(t: Tables) -> DataFrame:
    rows = experiments_of(t)
    inputs, _ = ft.external_inputs(
        rows.filter("outcome = 'import_failure'"), catalog_of(t), rows.filter("outcome = 'pass'")
    )
    assert not set(inputs.columns) & set(LABEL_COLUMNS)
    return inputs.select(*FEATURE_COLUMNS).withColumn(
        "package_a_release_ordinal", F.col("package_a_release_ordinal").cast("bigint")
    )


@query(
    "retry_list",
    """
with g as (select experiment_id, count(*) as n, min(outcome) as outcome from observations group by 1)
select experiment_id from matrix where experiment_id not in (select experiment_id from g where n = 1 and outcome <> 'infrastructure_failure')
""",
    "observations matrix",
)
def _(t: Tables) -> DataFrame:
    return retry_list(t.matrix, t.observations)


@query(
    "audit_after_repair",
    """
with g as (select experiment_id, count(*) as n, min(outcome) as outcome from observations group by 1),
k as (select experiment_id from g where n = 1 and outcome <> 'infrastructure_failure')
select count(m.experiment_id) as expected_experiments, count(k.experiment_id) as result_rows, count(k.experiment_id) as unique_result_ids, cast(0 as bigint) as duplicate_count,
  count(*) filter (where k.experiment_id is null) as missing_count, count(*) filter (where m.experiment_id is null) as extra_count, cast(0 as bigint) as invalid_spec_count,
  cast(0 as bigint) as infrastructure_failure_count, cast(0 as bigint) as invalid_outcome_count, cast(0 as bigint) as unmeasured_count, false as structural_valid, false as complete
from matrix m full join k on k.experiment_id = m.experiment_id
""",
    "observations matrix",
)
def _(t: Tables) -> DataFrame:
    results = t.observations.select(
        "experiment_id",
        "outcome",
        F.lit(True).alias("measured"),
        F.col("experiment_id").alias("calculated_id"),
    )
    return audited_log(t.matrix, results)
