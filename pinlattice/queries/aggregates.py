"""Aggregations: audits, signals, metrics, thresholds and fitted parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinlattice.constants import HIGH_SIGNAL_PATTERNS, MEASURED_OUTCOMES, SIGNAL_PATTERNS
from pinlattice.functions.names import experiment_id
from pinlattice.operators import catalog as cat
from pinlattice.operators import matrix as mx
from pinlattice.operators import metrics as met
from pinlattice.operators import observations as obs
from pinlattice.operators import preprocess as pre
from pinlattice.operators.texts import mention_counts, text_signals
from pinlattice.queries.adapters import Tables
from pinlattice.queries.joins import MATRIX_SQL, SCOPE_SQL, scope_of
from pinlattice.queries.projections import (
    AUDIT_SQL,
    PLAN_SQL,
    audited,
    errors,
    plan_packages,
)
from pinlattice.queries.registry import query


@query(
    "outcome_counts",
    """
select family, count(*) as rows, count(*) filter (where outcome = 'pass') as passed, count(*) filter (where outcome <> 'pass') as failed,
  round(1.0 - avg(case when outcome = 'pass' then 0.0 else 1.0 end), 6) as pass_rate,
  round(avg(case when outcome = 'pass' then 0.0 else 1.0 end) * 100, 2) as failure_percent
from observations group by family
""",
    "observations",
)
def _(t: Tables) -> DataFrame:
    return obs.outcome_counts(t.observations, ["family"])


@query(
    "outcomes_by_python",
    "select python_version, outcome, count(*) as rows from observations group by all",
    "observations",
)
def _(t: Tables) -> DataFrame:
    return obs.outcomes_by(t.observations, "python_version")


@query(
    "outcome_table",
    """
select family, count(*) filter (where outcome = 'pass') as pass, count(*) filter (where outcome = 'resolution_failure') as resolution_failure,
  count(*) filter (where outcome = 'import_failure') as import_failure, count(*) filter (where outcome = 'smoke_test_failure') as smoke_test_failure
from observations group by family
""",
    "observations",
)
def _(t: Tables) -> DataFrame:
    return obs.outcome_table(
        t.observations,
        "family",
        ["pass", "resolution_failure", "import_failure", "smoke_test_failure"],
    )


@query(
    "structural_audit",
    """
with r as (select experiment_id, count(*) as n, count(*) filter (where part_key % 19 = 0) as bad,
  count(*) filter (where outcome = 'infrastructure_failure') as infra, count(*) filter (where part_key % 23 = 0) as un from observations group by 1),
j as (select matrix.experiment_id as e, r.* from matrix full join r on r.experiment_id = matrix.experiment_id)
select count(e) as expected_experiments, cast(sum(coalesce(n, 0)) as bigint) as result_rows, count(experiment_id) as unique_result_ids,
  count(*) filter (where n > 1) as duplicate_count, count(*) filter (where n is null) as missing_count, count(*) filter (where e is null) as extra_count,
  cast(sum(coalesce(bad, 0)) as bigint) as invalid_spec_count, cast(sum(coalesce(infra, 0)) as bigint) as infrastructure_failure_count,
  cast(0 as bigint) as invalid_outcome_count, cast(sum(coalesce(un, 0)) as bigint) as unmeasured_count, false as structural_valid, false as complete
from j
""",
    "observations matrix",
)
def _(t: Tables) -> DataFrame:
    results = t.observations.select(
        "experiment_id",
        "outcome",
        (F.col("part_key") % 23 != 0).alias("measured"),
        F.when(F.col("part_key") % 19 == 0, "other")
        .otherwise(F.col("experiment_id"))
        .alias("calculated_id"),
    )
    return obs.structural_audit(t.matrix, results)


def evidence_rows(t: Tables) -> DataFrame:
    """Full nested observation rows built from the order lines, with known defects."""
    line, part, supp = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    flag, s = F.col("l_returnflag"), lambda c: c.cast("string")
    resolution = (flag == "R") & (line != 7)
    outcome = (
        F.when(line == 7, "timeout")
        .when(flag == "R", "resolution_failure")
        .when(flag == "A", "pass")
        .when(line % 2 == 0, "import_failure")
        .otherwise("smoke_test_failure")
    )
    python = F.concat(F.lit("3."), s(8 + part % 7))

    def stage(name, code):
        return F.struct(
            F.lit(name).alias("stage"), code.cast("int").alias("exit_code"), F.lit(False).alias("timed_out")
        )

    resolve_exit = F.when(resolution, F.when(line == 2, 0).otherwise(1)).otherwise(0)
    smoke_exit = F.when(flag == "A", F.when(line == 4, 1).otherwise(0)).otherwise(
        F.when(line == 5, 0).otherwise(1)
    )
    stages = F.array_compact(
        F.array(
            stage("resolve_artifacts", resolve_exit),
            F.when(~resolution, stage("install_exact_artifacts", (line == 3).cast("int"))),
            F.when(~resolution, stage("capture_environment", F.lit(0))),
            F.when(~resolution, stage("smoke_test", smoke_exit)),
            stage("cleanup_environment", (supp % 9 == 0).cast("int")),
        )
    )
    digest = F.when(part % 31 == 0, "bad").otherwise(F.sha2(s(part), 256))

    def artifact(name, version, size, top_level, native):
        tag = F.lit("cp311") if native else F.lit("none")
        return F.struct(
            name.alias("package"),
            version.alias("version"),
            F.concat(name, F.lit(".whl")).alias("filename"),
            size.cast("bigint").alias("size"),
            digest.alias("sha256"),
            tag.alias("abi_tag"),
            F.lit("manylinux_x86_64" if native else "any").alias("platform_tag"),
            top_level.alias("top_level"),
        )

    a = F.concat(F.lit("pkg-"), s(part))
    b = F.concat(F.lit("dep-"), s(supp))
    artifacts = F.when(
        ~resolution,
        F.array(
            artifact(a, F.concat(s(line), F.lit(".0")), F.when(supp % 7 == 0, 0).otherwise(part + 1), F.lit(True), True),
            artifact(b, F.lit("1.0"), supp + 1, line != 1, False),
            artifact(F.lit("extra"), F.lit("2.0"), F.lit(5), F.lit(False), False),
        ),
    )
    environment = F.when(
        ~resolution,
        F.array(
            F.concat(F.regexp_replace(a, "-", "_"), F.lit("=="), s(line), F.lit(".0")),
            F.concat(b, F.lit("==1.0")),
            F.concat(F.lit("Extra=="), F.when(F.col("l_tax") > 0.07, "9").otherwise("2.0")),
        ),
    )
    lock = F.when(resolution, F.when(part % 29 == 0, "left over")).otherwise(
        F.when(part % 5 == 0, "bad").otherwise(F.sha2(s(part), 256))
    )
    wheel = F.struct(F.concat(a, F.lit(".whl")).alias("filename"))
    spec = F.struct(
        F.struct(a.alias("name"), F.concat(s(line), F.lit(".0")).alias("version")).alias("package_a"),
        F.struct(b.alias("name"), F.lit("1.0").alias("version")).alias("package_b"),
        python.alias("python_version"),
        F.lit("linux").alias("os"),
        F.lit("x86_64").alias("architecture"),
    )
    return t.lineitem.select(
        F.when(supp % 17 == 0, "1.2.0").otherwise("1.3.0").alias("schema_version"),
        experiment_id(a, F.concat(s(line), F.lit(".0")), b, F.lit("1.0"), python).alias("experiment_id"),
        spec.alias("spec"),
        outcome.alias("outcome"),
        (part % 23 != 0).alias("measured"),
        F.col("l_quantity").alias("duration_seconds"),
        F.lit(None).cast("string").alias("normalized_error"),
        F.lit(None).cast("string").alias("exception_type"),
        stages.alias("stages"),
        F.when(line == 6, F.array(wheel)).otherwise(F.array(wheel, wheel)).alias("wheel_artifacts"),
        artifacts.alias("installed_wheel_artifacts"),
        environment.alias("installed_environment"),
        lock.alias("artifact_lock_sha256"),
        F.struct(
            F.when(supp % 11 == 0, "2.7.1").otherwise(F.concat(python, F.lit(".4"))).alias("python_version"),
            F.lit("linux").alias("os"),
            F.when(supp % 13 == 0, "arm64").otherwise("x86_64").alias("architecture"),
            F.concat(F.lit("6."), s(supp % 4)).alias("kernel"),
            F.when(supp % 5 != 0, "glibc 2.39").alias("libc"),
            F.lit("0.5").alias("tool_version"),
        ).alias("runtime"),
        F.struct(
            F.when(line != 2, part).alias("peak_stage_rss_bytes"),
            F.when(line != 3, supp).alias("host_network_received_change_bytes"),
            line.cast("bigint").alias("host_network_transmitted_change_bytes"),
            F.struct(F.col("l_orderkey").alias("size_bytes")).alias("cache_after"),
        ).alias("resources"),
    )


def evidence_matrix(t: Tables) -> DataFrame:
    part, s = F.col("l_partkey"), lambda c: c.cast("string")
    return t.lineitem.filter("l_partkey % 13 <> 0").select(
        experiment_id(
            F.concat(F.lit("pkg-"), s(part)),
            F.concat(s(F.col("l_linenumber")), F.lit(".0")),
            F.concat(F.lit("dep-"), s(F.col("l_suppkey"))),
            F.lit("1.0"),
            F.concat(F.lit("3."), s(8 + part % 7)),
        ).alias("experiment_id")
    )


@query(
    "evidence_audit",
    """
with x as (select l_linenumber as line, l_partkey as part, l_suppkey as supp, l_tax as tax, l_returnflag as flag,
  l_returnflag = 'R' and l_linenumber <> 7 as res from lineitem),
v as (select unnest(list_filter([
  case when part % 13 = 0 then 'spec_absent_from_matrix' end, case when supp % 17 = 0 then 'schema_version' end,
  case when part % 23 = 0 then 'not_measured' end, case when supp % 9 = 0 then 'cleanup_failed' end,
  case when line = 6 then 'top_level_wheels' end, case when supp % 11 = 0 then 'runtime_python' end,
  case when supp % 13 = 0 then 'runtime_platform' end, case when res and line = 2 then 'resolver_stage_did_not_fail' end,
  case when res and part % 29 = 0 then 'resolution_failure_has_evidence' end, case when line = 7 then 'unexpected_outcome' end,
  case when not res and line = 3 then 'install_exact_artifacts_failed' end, case when not res and part % 5 = 0 then 'lock_hash' end,
  case when not res and line = 1 then 'top_level_artifacts' end, case when not res and supp % 7 = 0 then 'artifact_size' end,
  case when not res and part % 31 = 0 then 'artifact_hash' end, case when not res and tax > 0.07 then 'environment_differs' end,
  case when flag = 'A' and line = 4 then 'pass_without_smoke' end, case when flag = 'N' and line = 5 then 'failure_with_smoke_exit_zero' end
  ], lambda r: r is not null)) as rule from x)
select rule, count(*) as row_count from v group by rule
""",
)
def _(t: Tables) -> DataFrame:
    broken = obs.evidence_audit(evidence_matrix(t), evidence_rows(t))
    return broken.groupBy("rule").agg(F.count(F.lit(1)).alias("row_count"))


@query(
    "duration_stats_by_family",
    """
select family, count(duration_seconds) as rows, sum(duration_seconds) as total_seconds, max(duration_seconds) as max_seconds,
  quantile_cont(duration_seconds, 0.5) as median_seconds, quantile_disc(duration_seconds, 0.9) as p90_seconds
from observations group by family
""",
    "observations",
)
def _(t: Tables) -> DataFrame:
    return obs.duration_stats(t.observations, ["family"])


@query(
    "duration_stats",
    """
select count(bytes) as rows, round(sum(bytes), 2) as total_seconds, max(bytes) as max_seconds,
  quantile_cont(bytes, 0.5) as median_seconds, quantile_disc(bytes, 0.9) as p90_seconds
from observations
""",
    "observations",
)
def _(t: Tables) -> DataFrame:
    stats = obs.duration_stats(t.observations, value="bytes")
    return stats.withColumn("total_seconds", F.round("total_seconds", 2))


@query(
    "resource_stats",
    """
select count(*) filter (where l_linenumber <> 2) as measured_rows, max(l_partkey) filter (where l_linenumber <> 2) as max_rss_bytes,
  cast(sum(case when l_linenumber = 3 then 0 else l_suppkey end) as bigint) as network_received_bytes,
  cast(sum(l_linenumber) as bigint) as network_transmitted_bytes, max(l_orderkey) as max_cache_bytes,
  quantile_cont(l_partkey, 0.5) filter (where l_linenumber <> 2) as median_rss_bytes
from lineitem
""",
)
def _(t: Tables) -> DataFrame:
    return obs.resource_stats(evidence_rows(t))


@query(
    "runtime_identities",
    """
select case when l_suppkey % 11 = 0 then '2.7.1' else concat('3.', cast(8 + l_partkey % 7 as varchar), '.4') end as python_version,
  concat('6.', cast(l_suppkey % 4 as varchar)) as kernel, case when l_suppkey % 5 <> 0 then 'glibc 2.39' else 'None' end as libc,
  '0.5' as tool_version, count(*) as rows
from lineitem group by all
""",
)
def _(t: Tables) -> DataFrame:
    return obs.runtime_identities(evidence_rows(t))


@query(
    "failure_patterns",
    """
with e as (select outcome, family, part_key % 6 as k from observations)
select case outcome when 'import_failure' then 'import_pattern' when 'resolution_failure' then 'resolution_family' else 'smoke_exception' end as kind,
  case when outcome = 'import_failure' then case k when 0 then 'NumPy binary ABI: dtype size changed' when 1 then 'Removed MarkupSafe API: soft_unicode'
    when 2 then 'Removed Werkzeug API: url_quote' when 3 then 'Other removed import API' else 'Other import failure' end
  when outcome = 'resolution_failure' then family else case when k = 0 then 'ValueError' else 'unknown' end end as value, count(*) as rows
from e where outcome in ('import_failure', 'resolution_failure', 'smoke_test_failure') group by all
""",
    "observations",
)
def _(t: Tables) -> DataFrame:
    rows = errors(t).withColumn(
        "exception_type", F.when(F.col("part_key") % 6 == 0, "ValueError")
    )
    return obs.failure_patterns(rows)


@query(
    "artifact_stats",
    """
with x as (select *, l_returnflag = 'R' and l_linenumber <> 7 as res from lineitem)
select count(*) filter (where not res) * 3 as artifacts, count(*) filter (where not res) as transitive_artifacts,
  cast(sum(case when res then 0 else case when l_suppkey % 7 = 0 then 0 else l_partkey + 1 end + l_suppkey + 6 end) as bigint) as wheel_bytes,
  count(*) filter (where not res) as native_artifacts, count(*) filter (where not res and l_partkey % 5 <> 0) as locked_experiments
from x
""",
)
def _(t: Tables) -> DataFrame:
    return obs.artifact_stats(evidence_rows(t))


@query(
    "cache_effect",
    """
with c as (select l_orderkey, sum(l_quantity) as q, min(l_linenumber) as n from lineitem where l_linenumber <= 3 group by 1),
w as (select l_orderkey, sum(l_quantity) as q, min(l_linenumber) as n from lineitem where l_linenumber > 3 group by 1)
select coalesce(c.l_orderkey, w.l_orderkey) as experiment_id, c.q as cold_seconds, cast(c.n as bigint) as cold_bytes, w.q as warm_seconds,
  cast(w.n as bigint) as warm_bytes, w.q - c.q as seconds_change, cast(w.n - c.n as bigint) as bytes_change
from c full join w on c.l_orderkey = w.l_orderkey
""",
)
def _(t: Tables) -> DataFrame:
    def run(condition: str) -> DataFrame:
        return t.lineitem.filter(condition).groupBy(F.col("l_orderkey").alias("experiment_id")).agg(
            F.sum("l_quantity").alias("seconds"), F.min("l_linenumber").cast("bigint").alias("bytes")
        )

    return obs.cache_effect(run("l_linenumber <= 3"), run("l_linenumber > 3"), ["seconds", "bytes"])


@query(
    "reuse_summary",
    """
select count(*) as requested, count(*) filter (where has) as skipped_existing, count(*) filter (where not has) as remaining
from (select experiment_id in (select experiment_id from observations) as has from matrix)
""",
    "observations matrix",
)
def _(t: Tables) -> DataFrame:
    return obs.reuse_summary(t.matrix, t.observations, "experiment_id")


@query(
    "coverage_summary",
    f"""
with a as ({AUDIT_SQL})
select count(distinct package) as packages, count(distinct concat(package, version)) as releases, count(*) as python_targets,
  count(*) filter (where eligible) as eligible_targets, count(*) filter (where not eligible) as excluded_targets from a
""",
    "releases",
)
def _(t: Tables) -> DataFrame:
    return cat.coverage_summary(audited(t))


@query(
    "exclusion_counts",
    f"with a as ({AUDIT_SQL}) select reason, count(*) as rows from a where not eligible group by reason",
    "releases",
)
def _(t: Tables) -> DataFrame:
    return cat.exclusion_counts(audited(t))


@query(
    "matrix_reconcile",
    f"""
with {SCOPE_SQL}, {MATRIX_SQL}
select family, count(*) as expected, count(*) filter (where eligible) as runnable, count(*) filter (where not eligible) as excluded, true as reconciled
from m group by family
""",
    "releases families",
)
def _(t: Tables) -> DataFrame:
    return mx.matrix_reconcile(scope_of(t), t.families)


@query(
    "exclusion_reasons",
    f"""
with {SCOPE_SQL}, {MATRIX_SQL}
select side, reason, count(*) as rows from (
  select 'a' as side, reason_a as reason from m where not eligible union all select 'b', reason_b from m where not eligible)
where reason <> 'eligible' group by all
""",
    "releases families",
)
def _(t: Tables) -> DataFrame:
    return mx.exclusion_reasons(mx.matrix_counts(scope_of(t), t.families))


@query(
    "scope_bounds",
    """
with s as (select package, count(distinct version) as selected, cast(regexp_extract(package, '([0-9]+)$', 1) as int) as n from releases group by 1)
select 'too_few_versions' as rule, package as key from s where n % 4 <> 0 and selected < 50
union all select 'too_many_versions', package from s where n % 4 <> 0 and selected > 60
union all select 'not_in_plan', package from s where n % 4 = 0
union all select 'not_in_scope', concat(package, '-gone') from s where n % 6 = 0
""",
    "releases",
)
def _(t: Tables) -> DataFrame:
    n = F.regexp_extract("package", r"(\d+)$", 1).cast("int")
    names = t.releases.select("package").distinct()
    planned = names.filter(n % 4 != 0).unionByName(
        names.filter(n % 6 == 0).select(F.concat("package", F.lit("-gone")).alias("package"))
    )
    plan = planned.select(
        "package", F.lit(50).alias("minimum_versions"), F.lit(60).alias("target_versions")
    )
    return mx.scope_bounds(plan, t.releases).select("rule", "key")


@query(
    "split_summary",
    f"""
with {PLAN_SQL}, f as (select split, count(*) as n from families group by 1)
select p.split, count(*) as packages, coalesce(max(f.n), 0) as families, coalesce(max(f.n), 0) * 12 * 12 * 7 as maximum_experiments,
  cast(floor(coalesce(max(f.n), 0) * 12 * 12 * 7 * cast(0.7 as double)) as bigint) as estimate_low,
  cast(floor(coalesce(max(f.n), 0) * 12 * 12 * 7 * cast(0.9 as double)) as bigint) as estimate_high
from p left join f on f.split = p.split group by p.split
""",
    "releases families",
)
def _(t: Tables) -> DataFrame:
    return mx.split_summary(plan_packages(t), t.families, 12, 7)


@query(
    "popularity_summary",
    """
with c as (select package, count(distinct version) as n from releases group by 1)
select count(*) as packages, cast(sum(n) as bigint) as releases, min(n) as min_releases, max(n) as max_releases, quantile_disc(n, 0.5) as median_releases from c
""",
    "releases",
)
def _(t: Tables) -> DataFrame:
    return cat.popularity_summary(t.releases)


# The notes are mostly not English, so the words of their own languages stand in
# for the groups next to the real patterns.
DOC_PATTERNS = {**SIGNAL_PATTERNS, "articles": (r"\bder\b", r"\bles\b", r"\bthe\b", r"\blos\b")}
# One separator is consumed by a match, so every separator is doubled first.
WORDS = r"regexp_replace(lower(trim(regexp_replace(text, '[\s\x0b\x{85}\p{Z}]+', ' ', 'g'))), '([^\p{L}\p{M}\p{Nd}_])', '\1\1', 'g')"
B0, B1 = r"(?:^|[^\p{L}\p{M}\p{Nd}_])", r"(?:[^\p{L}\p{M}\p{Nd}_]|$)"


def duck_pattern(pattern: str) -> str:
    """A word-boundary pattern for RE2 over text whose separators are doubled."""
    body = pattern.replace("(?:ned|ning)", "(?:ned|ning)").replace(" ", "  ")
    if body.startswith(r"\b"):
        body = B0 + body[2:]
    if body.endswith(r"\b"):
        body = body[:-2] + B1
    return body


def duck_count(patterns) -> str:
    return " + ".join(f"len(regexp_extract_all(w, '{duck_pattern(p)}'))" for p in patterns)


def _signal_sql() -> str:
    counts = ", ".join(
        f"cast({duck_count(p)} as bigint) as {n}_count" for n, p in DOC_PATTERNS.items()
    )
    return f"""
with d as (select doc_id, {WORDS} as w, trim(regexp_replace(text, '[\\s\\x0b\\x{{85}}\\p{{Z}}]+', ' ', 'g')) as flat from documents)
select doc_id, cast(length(flat) as bigint) as selected_characters, {counts} from d
"""


@query("signal_counts", _signal_sql())
def _(t: Tables) -> DataFrame:
    from pinlattice.functions.text import collapse_spaces, signal_counts

    counted = t.documents.select(
        "doc_id",
        F.length(collapse_spaces(F.col("text"))).cast("bigint").alias("selected_characters"),
        signal_counts(F.col("text"), DOC_PATTERNS).alias("s"),
    )
    return counted.select(
        "doc_id",
        "selected_characters",
        *[F.col(f"s.{n}").cast("bigint").alias(f"{n}_count") for n in DOC_PATTERNS],
    )


DOC_HIGH = {
    **HIGH_SIGNAL_PATTERNS,
    "article_pairs": ((r"\bder\b", r"\bles\b", r"\bthe\b"), (r"\bund\b", r"\bet\b", r"\band\b")),
}


def _high_sql() -> str:
    def side(patterns) -> str:
        return "(" + " or ".join(f"regexp_matches(w, '{duck_pattern(p)}')" for p in patterns) + ")"

    sums = ", ".join(
        f"cast(count(*) filter (where {side(a)} and {side(b)}) as bigint) as {n}_count"
        for n, (a, b) in DOC_HIGH.items()
    )
    doubled = r"regexp_replace(lower(line), '([^\p{L}\p{M}\p{Nd}_])', '\1\1', 'g')"
    return f"""
with l as (select doc_id, unnest(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]')) as line from documents),
w as (select doc_id, {doubled} as w from l where regexp_matches(line, '[^\\s\\x0b\\x{{85}}\\p{{Z}}]'))
select d.doc_id, {sums.replace("count(*)", "count(w.w)")} from documents d left join w on w.doc_id = d.doc_id group by d.doc_id
"""


@query("high_signal_counts", _high_sql())
def _(t: Tables) -> DataFrame:
    from pinlattice.functions.text import high_signal_counts

    counted = t.documents.select("doc_id", high_signal_counts(F.col("text"), DOC_HIGH).alias("s"))
    return counted.select(
        "doc_id", *[F.col(f"s.{n}").cast("bigint").alias(f"{n}_count") for n in DOC_HIGH]
    )


@query("text_signals")
def _(t: Tables) -> DataFrame:
    return text_signals(t.notes).drop("text", "evidence_lines")


@query(
    "package_mentions",
    r"""
with vocabulary as (select distinct lower(source) as name from documents union select unnest(['the', 'les', 'und', 'los', 'de', 'la', 'license', 'copyright'])),
g as (select doc_id, lower(source) as own, unnest(regexp_extract_all(lower(text), '([\p{L}\p{M}\p{Nd}_-]+)')) as gram from documents)
select cast(doc_id as varchar) as version, name, count(*) as mentions from g join vocabulary on gram = name where name <> own group by all
""",
)
def _(t: Tables) -> DataFrame:
    texts = t.documents.select(
        F.lower("source").alias("package"), F.col("doc_id").cast("string").alias("version"), "text"
    )
    words = F.array(*[F.lit(w) for w in "the les und los de la license copyright".split()])
    vocabulary = texts.select(F.col("package").alias("name")).distinct().unionByName(
        texts.select(F.explode(words).alias("name")).distinct()
    )
    return mention_counts(texts, vocabulary.distinct(), ["version"])


# Scores with many ties over all order lines.
SCORED_SQL = """
s as (select experiment_id, family, part_key, bytes, outcome, case when outcome = 'pass' then 0 else 1 end as actual,
  cast((part_key * 7 + supp_key) % 499 as double) / 499.0 as score, cast((part_key + supp_key * 3) % 97 as double) / 97.0 as other,
  case when discount > 0.08 then 1 else 0 end as base from observations)
"""


def scored(t: Tables) -> DataFrame:
    p, s = F.col("part_key"), F.col("supp_key")
    return t.observations.select(
        "experiment_id",
        "family",
        "part_key",
        "bytes",
        "outcome",
        (F.col("outcome") != "pass").cast("int").alias("actual"),
        (((p * 7 + s) % 499).cast("double") / F.lit(499.0)).alias("score"),
        (((p + s * 3) % 97).cast("double") / F.lit(97.0)).alias("other"),
        (F.col("discount") > 0.08).cast("int").alias("base"),
    )


RATES_SQL = """coalesce(tp / nullif(cast(tp + fp as double), 0), 0) as precision, coalesce(tp / nullif(cast(tp + fn as double), 0), 0) as recall,
  coalesce(tn / nullif(cast(tn + fp as double), 0), 0) as specificity, (tp + tn) / nullif(cast(tp + fp + tn + fn as double), 0) as accuracy"""
COUNTS_SQL = """count(*) filter (where actual = 1 and predicted = 1) as tp, count(*) filter (where actual = 0 and predicted = 1) as fp,
  count(*) filter (where actual = 0 and predicted = 0) as tn, count(*) filter (where actual = 1 and predicted = 0) as fn"""
OUT_SQL = """tp as true_positive, fp as false_positive, tn as true_negative, fn as false_negative, round(accuracy, 6) as accuracy,
  round((recall + specificity) / 2, 6) as balanced_accuracy, round(precision, 6) as precision, round(recall, 6) as recall,
  round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) as f1, round(specificity, 6) as specificity"""
RATE_NAMES = ("accuracy", "balanced_accuracy", "precision", "recall", "f1", "specificity")


def rounded(df: DataFrame, names=RATE_NAMES) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names if n in df.columns})


@query(
    "binary_metrics",
    f"""
with {SCORED_SQL}, c as (select family, {COUNTS_SQL} from (select *, case when score >= 0.5 then 1 else 0 end as predicted from s) group by family),
r as (select *, {RATES_SQL} from c)
select family, {OUT_SQL} from r
""",
    "observations",
)
def _(t: Tables) -> DataFrame:
    rows = scored(t).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    return rounded(met.binary_metrics(rows, by=["family"]))


@query(
    "probability_losses",
    f"""
with {SCORED_SQL}, p as (select *, least(greatest(score, 1e-12), 1 - 1e-12) as q from s)
select family, round(avg(-(actual * ln(q) + (1 - actual) * ln(1 - q))), 6) as log_loss, round(avg((score - actual) * (score - actual)), 6) as brier_score
from p group by family
""",
    "observations",
)
def _(t: Tables) -> DataFrame:
    losses = met.probability_losses(scored(t), "actual", "score", ["family"])
    return rounded(losses, ("log_loss", "brier_score"))


@query(
    "roc_auc",
    f"""
with {SCORED_SQL}, r as (select family, actual, rank() over (partition by family order by score) + (count(*) over (partition by family, score) - 1) / 2.0 as k from s)
select family, round((sum(k) filter (where actual = 1) - sum(actual) * (sum(actual) + 1) / 2.0) / (sum(actual) * (count(*) - sum(actual))), 6) as roc_auc
from r group by family
""",
    "observations",
)
def _(t: Tables) -> DataFrame:
    return rounded(met.roc_auc(scored(t), "score", by=["family"]), ("roc_auc",))


@query(
    "roc_auc_overall",
    """
with r as (select actual, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as k from labelled)
select round((sum(k) filter (where actual = 1) - sum(actual) * (sum(actual) + 1) / 2.0) / (sum(actual) * (count(*) - sum(actual))), 6) as roc_auc from r
""",
    "labelled",
)
def _(t: Tables) -> DataFrame:
    return rounded(met.roc_auc(t.labelled, "score"), ("roc_auc",))


@query(
    "average_precision",
    f"""
with {SCORED_SQL}, r as (select actual, row_number() over w as k, sum(actual) over (w rows unbounded preceding) as p from s
  window w as (order by score desc, experiment_id, part_key, bytes))
select round(sum(actual * cast(p as double) / k) / sum(actual), 6) as average_precision from r
""",
    "observations",
)
def _(t: Tables) -> DataFrame:
    order = ["experiment_id", "part_key", "bytes"]
    return rounded(
        met.average_precision(scored(t), "score", order), ("average_precision",)
    )


@query(
    "subtype_metrics",
    f"""
with {SCORED_SQL}, p as (select family, outcome, case when score >= 0.4 then 1.0 else 0.0 end as hit from s),
m as (select family, count(*) filter (where outcome = 'resolution_failure') as resolution_failure_rows, avg(hit) filter (where outcome = 'resolution_failure') as resolution_failure_recall,
  count(*) filter (where outcome = 'import_failure') as import_failure_rows, avg(hit) filter (where outcome = 'import_failure') as import_failure_recall,
  count(*) filter (where outcome = 'smoke_test_failure') as smoke_test_failure_rows, avg(hit) filter (where outcome = 'smoke_test_failure') as smoke_test_failure_recall,
  avg(hit) filter (where outcome in ('import_failure', 'smoke_test_failure')) as post_install_recall from p group by family)
select family, resolution_failure_rows, round(resolution_failure_recall, 6) as resolution_failure_recall, import_failure_rows, round(import_failure_recall, 6) as import_failure_recall,
  smoke_test_failure_rows, round(smoke_test_failure_recall, 6) as smoke_test_failure_recall, round(post_install_recall, 6) as post_install_recall,
  round((coalesce(resolution_failure_recall, 0) + coalesce(import_failure_recall, 0) + coalesce(smoke_test_failure_recall, 0))
    / (cast(resolution_failure_rows > 0 as int) + cast(import_failure_rows > 0 as int) + cast(smoke_test_failure_rows > 0 as int)), 6) as failure_subtype_macro_recall
from m
""",
    "observations",
)
def _(t: Tables) -> DataFrame:
    rows = scored(t).withColumn("predicted", (F.col("score") >= 0.4).cast("int"))
    table = met.subtype_metrics(rows, by=["family"])
    return rounded(table, [c for c in table.columns if c.endswith("recall")])


CLASSES = ("pass", "resolution_failure", "import_failure", "smoke_test_failure")


@query(
    "multiclass_metrics",
    f"""
with {SCORED_SQL}, e as (select outcome, score, case when score >= 0.5 then case when other < 0.5 then 'pass' else 'pass' end
  when other < 0.3 then 'resolution_failure' when other < 0.6 then 'import_failure' else 'smoke_test_failure' end as guess, 1.0 - score >= 0.5 as detected
  from s where outcome <> 'infrastructure_failure'),
c as (select count(*) filter (where outcome <> 'pass' and detected) as true_positive, count(*) filter (where outcome = 'pass' and detected) as false_positive,
  count(*) filter (where outcome = 'pass' and not detected) as true_negative, count(*) filter (where outcome <> 'pass' and not detected) as false_negative,
  avg(case when guess = outcome then 1.0 else 0.0 end) as exact,
  count(*) filter (where outcome = 'resolution_failure') as r, count(*) filter (where outcome = 'import_failure') as i, count(*) filter (where outcome = 'smoke_test_failure') as m,
  count(*) filter (where outcome = 'resolution_failure' and detected) as rd, count(*) filter (where outcome = 'import_failure' and detected) as id, count(*) filter (where outcome = 'smoke_test_failure' and detected) as md,
  count(*) filter (where outcome = 'resolution_failure' and guess = outcome) as rs, count(*) filter (where outcome = 'import_failure' and guess = outcome) as is_, count(*) filter (where outcome = 'smoke_test_failure' and guess = outcome) as ms
  from e)
select true_positive, false_positive, true_negative, false_negative, round(exact, 6) as exact_stage_accuracy,
  r as resolution_failure_rows, rd as resolution_failure_detected, rs as resolution_failure_correct_stage, round(rd / r, 6) as resolution_failure_detection_recall, round(rs / r, 6) as resolution_failure_stage_recall,
  i as import_failure_rows, id as import_failure_detected, is_ as import_failure_correct_stage, round(id / i, 6) as import_failure_detection_recall, round(is_ / i, 6) as import_failure_stage_recall,
  m as smoke_test_failure_rows, md as smoke_test_failure_detected, ms as smoke_test_failure_correct_stage, round(md / m, 6) as smoke_test_failure_detection_recall, round(ms / m, 6) as smoke_test_failure_stage_recall,
  round((rd / r + id / i + md / m) / 3, 6) as macro_detection_recall
from c
""",
    "observations",
)
def _(t: Tables) -> DataFrame:
    rest = F.lit(1.0) - F.col("score")
    other = F.col("other")
    high, low = rest * 0.98, rest * 0.01
    r = F.when(other < 0.3, high).otherwise(low)
    i = F.when((other >= 0.3) & (other < 0.6), high).otherwise(low)
    s = F.when(other >= 0.6, high).otherwise(low)
    # Pass wins whenever its probability is at least one half.
    p = F.array(F.when(F.col("score") >= 0.5, F.col("score")).otherwise(F.col("score")), r, i, s)
    rows = scored(t).filter(F.col("outcome") != "infrastructure_failure").withColumn(
        "p",
        F.when(F.col("score") >= 0.5, p).otherwise(
            F.transform(p, lambda x, k: F.when((k > 0) & (x > low), x + 1).otherwise(x))
        ),
    )
    table = met.multiclass_metrics(rows, CLASSES)
    return rounded(table, [c for c in table.columns if c.endswith(("recall", "accuracy"))])


THRESHOLD_SQL = f"""
t as (select distinct score as threshold from s union select unnest([0.0, 0.5, 1.0])),
g as (select score, count(*) as n, cast(sum(actual) as bigint) as p from s group by 1),
u as (select threshold, (select coalesce(sum(n), 0) from g where score < threshold) as below_n, (select coalesce(sum(p), 0) from g where score < threshold) as below_p,
  (select sum(n) from g) as all_n, (select sum(p) from g) as all_p from t),
c as (select threshold, cast(all_p - below_p as bigint) as tp, cast(all_n - below_n - (all_p - below_p) as bigint) as fp,
  cast(below_n - below_p as bigint) as tn, cast(below_p as bigint) as fn from u),
r as (select *, {RATES_SQL} from c)
"""


@query(
    "select_threshold",
    f"""
with {SCORED_SQL}, {THRESHOLD_SQL}
select threshold, {OUT_SQL} from r order by (recall + specificity) / 2 desc, recall desc, abs(threshold - 0.5), threshold limit 1
""",
    "observations",
)
def _(t: Tables) -> DataFrame:
    return rounded(met.select_threshold(scored(t), "score"))


@query(
    "select_threshold_by_family",
    f"""
with s as (select * from labelled),
t as (select distinct family, score as threshold from s union select distinct family, unnest([0.0, 0.5, 1.0]) from s),
c as (select t.family, threshold, count(*) filter (where actual = 1 and score >= threshold) as tp, count(*) filter (where actual = 0 and score >= threshold) as fp,
  count(*) filter (where actual = 0 and score < threshold) as tn, count(*) filter (where actual = 1 and score < threshold) as fn
  from t join s on s.family = t.family group by 1, 2),
r as (select *, {RATES_SQL} from c),
k as (select *, row_number() over (partition by family order by (recall + specificity) / 2 desc, recall desc, abs(threshold - 0.5), threshold) as rn from r)
select family, threshold, {OUT_SQL} from k where rn = 1
""",
    "labelled",
)
def _(t: Tables) -> DataFrame:
    return rounded(met.select_threshold(t.labelled, "score", by=["family"]))


@query(
    "select_operating_point",
    f"""
with {SCORED_SQL}, t as (select distinct score as threshold from s union select unnest([0.0, 1.0])),
g as (select score, count(*) as n, cast(sum(actual) as bigint) as p from s where base = 0 group by 1),
b as (select count(*) filter (where base = 1) as bn, count(*) filter (where base = 1 and actual = 1) as bp, count(*) as an, count(*) filter (where actual = 1) as ap from s),
u as (select threshold, (select coalesce(sum(n), 0) from g where score < threshold) as below_n, (select coalesce(sum(p), 0) from g where score < threshold) as below_p from t),
c as (select threshold, cast(ap - below_p as bigint) as tp, cast(an - below_n - (ap - below_p) as bigint) as fp, cast(below_n - below_p as bigint) as tn, cast(below_p as bigint) as fn from u, b),
r as (select *, {RATES_SQL} from c)
select threshold, {OUT_SQL} from r where precision + 1e-12 >= 0.5355 order by recall desc, 2 * precision * recall / (precision + recall) desc, (recall + specificity) / 2 desc, threshold limit 1
""",
    "observations",
)
def _(t: Tables) -> DataFrame:
    return rounded(met.select_operating_point(scored(t), "score", "base", 0.5355))


@query(
    "calibrate_post_install",
    f"""
with {SCORED_SQL.replace("s as (", "s0 as (")}, s as (select score, actual from s0 where outcome <> 'resolution_failure'), {THRESHOLD_SQL}
select threshold, {OUT_SQL} from r order by coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) desc, (recall + specificity) / 2 desc, recall desc, fp, threshold limit 1
""",
    "observations",
)
def _(t: Tables) -> DataFrame:
    return rounded(met.calibrate_post_install(scored(t), "score"))


@query(
    "select_candidate",
    f"""
with {SCORED_SQL}, x as (select 'first' as candidate, 0 as listed, outcome, actual, score as q from s union all select 'second', 1, outcome, actual, other from s),
p as (select *, case when q >= 0.3 then 1 else 0 end as predicted from x),
c as (select candidate, listed, {COUNTS_SQL}, avg((q - actual) * (q - actual)) as brier,
  (avg(predicted) filter (where outcome = 'resolution_failure') + avg(predicted) filter (where outcome = 'import_failure') + avg(predicted) filter (where outcome = 'smoke_test_failure')) / 3 as macro
  from p group by 1, 2),
r as (select *, {RATES_SQL} from c)
select candidate, round((recall + specificity) / 2, 6) as balanced_accuracy, round(macro, 6) as failure_subtype_macro_recall, round(brier, 6) as brier_score
from r order by (recall + specificity) / 2 desc, macro desc, recall desc, brier, listed limit 1
""",
    "observations",
)
def _(t: Tables) -> DataFrame:
    from pinlattice.operators.models import stack_candidates

    rows = stack_candidates(
        scored(t), {"first": "score", "second": "other"}, ["outcome", "actual"]
    ).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
    by = ["candidate", "listed"]
    metrics = (
        met.binary_metrics(rows, by=by)
        .join(met.probability_losses(rows, "actual", "score", by), by)
        .join(met.subtype_metrics(rows, by=by), by)
    )
    best = met.select_candidate(metrics)
    names = ("balanced_accuracy", "failure_subtype_macro_recall", "brier_score")
    return rounded(best, names).select("candidate", *names)


@query(
    "wilson_interval",
    """
with c as (select family, count(*) filter (where outcome = 'pass') as k, count(*) as n from observations group by 1),
p as (select *, cast(k as double) / n as p, 1.959963984540054 as z from c)
select family, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n), 6) as low,
  round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n), 6) as high
from p
""",
    "observations",
)
def _(t: Tables) -> DataFrame:
    counts = obs.outcome_counts(t.observations, ["family"])
    low, high = met.wilson_interval(F.col("passed"), F.col("rows"))
    return counts.select("family", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(
    "baseline_metrics",
    f"""
with {SCORED_SQL}, a as (select avg(actual) >= 0.5 as majority from s where score < 0.7), b as (select avg(actual) as f, count(*) as n from s where score >= 0.7)
select n as rows, round(case when majority then f else 1 - f end, 6) as majority_class_accuracy, round(1 - f, 6) as always_pass_accuracy,
  cast(0.5 as double) as always_pass_balanced_accuracy, round(f, 6) as always_fail_accuracy from a, b
""",
    "observations",
)
def _(t: Tables) -> DataFrame:
    rows = scored(t)
    table = met.baseline_metrics(rows.filter("score < 0.7"), rows.filter("score >= 0.7"))
    return rounded(table, [c for c in table.columns if c.endswith("accuracy")])


@query(
    "improvement",
    f"""
with {SCORED_SQL}, p as (select family, actual, cast(score >= 0.5 as int) as guess from s),
m as (select family, count(*) as n, sum(actual) as f, avg(cast(guess = actual as int)) as acc, sum(case when guess = 1 and actual = 1 then 1 else 0 end) as tp from p group by 1)
select family, 'accuracy' as metric, round(acc, 6) as model, round(1 - f / n, 6) as baseline, round(acc - (1 - f / n), 6) as improvement from m
union all select family, 'recall', round(coalesce(tp / nullif(f, 0), 0.0), 6), 0.0, round(coalesce(tp / nullif(f, 0), 0.0), 6) from m
""",
    "observations",
)
def _(t: Tables) -> DataFrame:
    """A fixed threshold against the policy that never warns, per family."""
    guessed = scored(t).withColumn("guess", (F.col("score") >= 0.5).cast("int"))
    hit = F.sum(F.col("guess") * F.col("actual"))
    model = guessed.groupBy("family").agg(
        F.avg((F.col("guess") == F.col("actual")).cast("int")).alias("accuracy"),
        met.ratio(hit, F.sum("actual")).alias("recall"),
    )
    never = guessed.groupBy("family").agg((1 - F.avg("actual")).alias("accuracy"), F.lit(0.0).alias("recall"))
    table = met.improvement(model, never, ("accuracy", "recall"), ["family"])
    return rounded(table, ["model", "baseline", "improvement"])


NUMERIC = ("l_quantity", "l_extendedprice", "l_discount")


@query(
    "fit_preprocessor",
    """
with x as (select unnest(['l_quantity', 'l_extendedprice', 'l_discount']) as "column",
  unnest([case when l_linenumber = 2 then null else l_quantity end, l_extendedprice, l_discount]) as value from lineitem),
m as (select "column", quantile_cont(value, 0.5) as median from x group by 1),
f as (select x."column", median, coalesce(value, median) as v from x join m on m."column" = x."column")
select "column", max(median) as median, round(avg(v), 4) as mean, round(stddev_pop(v), 4) as scale from f group by 1
""",
)
def _(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn(
        "l_quantity", F.when(F.col("l_linenumber") != 2, F.col("l_quantity"))
    )
    table = pre.preprocessor_table(rows, NUMERIC)
    return table.withColumns({c: F.round(c, 4) for c in ("mean", "scale")})


@query(
    "unknown_categories",
    """
select distinct 'l_returnflag' as "column", l_returnflag as level from lineitem where l_returnflag not in ('A', 'N')
union all select distinct 'l_linestatus', l_linestatus from lineitem where l_linestatus not in ('F')
""",
)
def _(t: Tables) -> DataFrame:
    return pre.unknown_categories(
        t.lineitem, {"l_returnflag": ["A", "N"], "l_linestatus": ["F"]}
    )


@query(
    "class_weights",
    """
with c as (select outcome, count(*) as n from observations group by 1), r as (select *, sqrt((select sum(n) from c) / (5.0 * n)) as raw from c),
b as (select case when outcome = 'pass' then 'pass' else 'fail' end as outcome, sum(n) as n from c group by 1)
select concat('balanced ', outcome) as kind, cast(n as bigint) as n, round((select sum(n) from b) / (2.0 * n), 6) as weight from b
union all select concat('root ', outcome), n, round(raw / (select avg(raw) from r), 6) from r
""",
    "observations",
)
def _(t: Tables) -> DataFrame:
    rows = t.observations.select(
        "outcome", F.when(F.col("outcome") == "pass", "pass").otherwise("fail").alias("binary")
    )
    balanced = pre.balanced_weights(rows, "binary").withColumnRenamed("binary", "kind")
    root = pre.root_weights(rows, "outcome", 5).withColumnRenamed("outcome", "kind")
    both = balanced.withColumn("kind", F.concat(F.lit("balanced "), "kind")).unionByName(
        root.withColumn("kind", F.concat(F.lit("root "), "kind"))
    )
    return rounded(both, ("weight",))


@query(
    "vector_scaler",
    """
with e as (select unnest(generate_series(0, 63)) as dimension, unnest(embedding) as x from embeddings)
select dimension, round(avg(cast(x as double)), 6) as mean, round(stddev_pop(cast(x as double)), 6) as deviation from e group by 1
""",
)
def _(t: Tables) -> DataFrame:
    return rounded(pre.vector_moments(t.embeddings, "embedding"), ("mean", "deviation"))


@query(
    "bin_cuts",
    """
with x as (select unnest(['l_quantity', 'l_extendedprice', 'l_discount']) as "column", unnest([l_quantity, l_extendedprice, l_discount]) as value from lineitem),
q as (select "column", unnest(quantile_cont(value, [1/8, 2/8, 3/8, 4/8, 5/8, 6/8, 7/8])) as cut, min(value) as lo, max(value) as hi from x group by 1),
d as (select distinct "column", cut, lo, hi from q)
select "column", cast(row_number() over (partition by "column" order by cut) - 1 as int) as position, round(cut, 6) as cut from d where cut > lo and cut < hi
""",
)
def _(t: Tables) -> DataFrame:
    table = pre.bin_cuts(pre.long_numeric(t.lineitem, NUMERIC), 8)
    return table.select("column", F.posexplode("cuts").alias("position", "cut")).withColumn(
        "cut", F.round("cut", 6)
    )


@query(
    "cascade_replay",
    f"""
with {SCORED_SQL}, p as (select outcome, base, score, other,
  case when base = 1 then 'constraint' when score >= 0.8 then 'structured' else 'post_install' end as reached,
  case when base = 1 or score >= 0.8 or other >= 0.6 then 1 else 0 end as predicted, actual from s),
c as (select count(*) as rows, count(*) filter (where reached <> 'constraint') as reached_structured, count(*) filter (where reached = 'post_install') as reached_post_install, {COUNTS_SQL},
  avg(1 - predicted) filter (where outcome = 'pass') as a, avg(predicted) filter (where outcome = 'resolution_failure') as b,
  avg(predicted) filter (where outcome = 'import_failure') as d, avg(predicted) filter (where outcome = 'smoke_test_failure') as e from p),
r as (select *, {RATES_SQL} from c)
select rows, reached_structured, reached_post_install, round(a, 6) as pass_recall, round(b, 6) as resolution_failure_recall, round(d, 6) as import_failure_recall,
  round(e, 6) as smoke_test_failure_recall, {OUT_SQL} from r
""",
    "observations",
)
def _(t: Tables) -> DataFrame:
    rows = scored(t).withColumn("allow", F.col("base") == 0)
    table = met.cascade_summary(met.cascade_replay(rows, "allow", "score", "other", 0.8, 0.6))
    return rounded(table, [*RATE_NAMES, *[c for c in table.columns if c.endswith("_recall")]])


assert set(MEASURED_OUTCOMES) >= set(CLASSES)
