"""Batch recommendation over requests made from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinlattice.constants import MAXIMUM_CHECKS
from pinlattice.operators.scoring import post_install_decision
from pinlattice.plans import advisor as adv
from pinlattice.queries.adapters import Tables
from pinlattice.queries.joins import MATRIX_SQL, SCOPE_SQL, matrix_of
from pinlattice.queries.registry import query
from pinlattice.session import materialize


def pins_of(t: Tables) -> DataFrame:
    """One pin per (request, package): the smallest version ordered."""
    return t.pins.groupBy("request_id", "package").agg(F.min("version").alias("version"))


def python_of(request):
    return F.concat(F.lit("3."), (8 + request % 7).cast("string"))


def environments_of(t: Tables, pins: DataFrame | None = None) -> DataFrame:
    return (pins_of(t) if pins is None else pins).select(
        F.col("request_id").alias("env_id"), python_of(F.col("request_id")).alias("python_version"), "package", "version"
    )


def requests_of(t: Tables, pins: DataFrame | None = None) -> DataFrame:
    return (pins_of(t) if pins is None else pins).groupBy("request_id").agg(F.min("package").alias("target_package")).select(
        "request_id",
        python_of(F.col("request_id")).alias("python_version"),
        "target_package",
        F.concat(F.lit("2."), (F.col("request_id") % 10).cast("string"), F.lit(".0")).alias("requested_version"),
    )


def pair_features(t: Tables) -> DataFrame:
    """Feature rows of all runnable release pairs with published constraints and frozen scores."""
    part = lambda v, i: F.element_at(F.split(v, r"\."), i).cast("int")
    a1, a2, a3 = (part("version_a", i) for i in (1, 2, 3))
    b1, b2 = part("version_b", 1), part("version_b", 2)
    known = a3 != 2
    return matrix_of(t, runnable_only=True).select(
        "experiment_id",
        F.col("package_a").alias("package_a_name"),
        F.col("version_a").alias("package_a_version"),
        F.col("package_b").alias("package_b_name"),
        F.col("version_b").alias("package_b_version"),
        "python_version",
        F.lit(0).alias("listed"),
        (a2 % 2 == 0).alias("package_a_declares_package_b"),
        F.when(b2 % 3 == 0, True).when(b2 % 3 == 1, False).alias("package_a_requirement_allows_b"),
        F.lit(False).alias("package_b_declares_package_a"),
        F.lit(None).cast("boolean").alias("package_b_requirement_allows_a"),
        F.lit("dep<2").alias("package_a_requirement_on_b"),
        F.lit(None).cast("string").alias("package_b_requirement_on_a"),
        (((a2 * 7 + b2 * 3 + a1) % 10) / F.lit(10.0)).alias("structured_probability"),
        F.when(known, ((a2 + b1) % 10) / F.lit(20.0)).alias("import_probability"),
        F.when(known, ((a1 + b2) % 7) / F.lit(20.0)).alias("smoke_probability"),
    )


def scored_pairs(t: Tables) -> DataFrame:
    rows = post_install_decision(adv.with_constraints(pair_features(t)))
    return materialize(
        rows.select(*adv._key_columns(), "experiment_id", "listed", *adv.SCORES)
    )


PAIR_SQL = f"""
{SCOPE_SQL}, {MATRIX_SQL},
v as (select *, cast(split_part(version_a, '.', 1) as int) as a1, cast(split_part(version_a, '.', 2) as int) as a2, cast(split_part(version_a, '.', 3) as int) as a3,
  cast(split_part(version_b, '.', 1) as int) as b1, cast(split_part(version_b, '.', 2) as int) as b2 from m where eligible),
x as (select *, a2 % 2 <> 0 or b2 % 3 = 0 as allow, ((a2 * 7 + b2 * 3 + a1) % 10) / cast(10.0 as double) as risk, case when a3 <> 2 then ((a2 + b1) % 10) / cast(20.0 as double) end as i,
  case when a3 <> 2 then ((a1 + b2) % 7) / cast(20.0 as double) end as s from v),
f as (select *, 1 - (1 - i) * (1 - s) as combined, 1 - (1 - i) * (1 - s) >= 0.4726886805608258 as warned from x),
o as (select package_a as target, version_a as tv, package_b as related, version_b as rv, python_version, allow, risk, coalesce(warned, false) as warned from f
  union all select package_b, version_b, package_a, version_a, python_version, allow, risk, coalesce(warned, false) from f),
fam as (select distinct least(package_a, package_b) as lo, greatest(package_a, package_b) as hi, python_version from f)
"""
REQUEST_SQL = """
env as (select request_id, concat('3.', cast(8 + request_id % 7 as varchar)) as python_version, package, min(version) as version from pins group by 1, 2, 3),
req as (select request_id, python_version, min(package) as target, concat('2.', cast(request_id % 10 as varchar), '.0') as requested from env group by 1, 2),
rel as (select r.request_id, r.python_version, r.target, e.package as related, e.version as cur from req r join env e on e.request_id = r.request_id and e.package <> r.target
  join fam on lo = least(r.target, e.package) and hi = greatest(r.target, e.package) and fam.python_version = r.python_version)
"""
DIST = """abs(cast(split_part({0}, '.', 1) as bigint) - cast(split_part({1}, '.', 1) as bigint)) * 1000000 + abs(cast(split_part({0}, '.', 2) as bigint) - cast(split_part({1}, '.', 2) as bigint)) * 1000
  + abs(cast(split_part({0}, '.', 3) as bigint) - cast(split_part({1}, '.', 3) as bigint))"""
OPTION_SQL = f"""
opt as (select * from (select g.*, o.tv, o.rv, o.rv <> g.cur as changed, {DIST.format('o.rv', 'g.cur')} as distance, o.risk,
    row_number() over (partition by g.python_version, g.target, g.related, g.cur, o.tv order by o.rv <> g.cur, {DIST.format('o.rv', 'g.cur')}, o.risk, o.rv) as option
  from (select distinct python_version, target, related, cur from rel) g join o on o.target = g.target and o.related = g.related and o.python_version = g.python_version and o.allow) where option <= 3)
"""
CANDIDATE_SQL = """
w as (select request_id, count(*) as n from rel group by 1),
step as (select rel.request_id, opt.tv, rel.related, opt.rv, opt.changed, opt.risk, w.n, dense_rank() over (partition by rel.request_id order by rel.related) as k
  from rel join opt on opt.python_version = rel.python_version and opt.target = rel.target and opt.related = rel.related and opt.cur = rel.cur join w on w.request_id = rel.request_id),
cand as (select request_id, tv, related as packages, rv as versions, cast(changed as int) as changes, risk from step where n = 1
  union all select a.request_id, a.tv, concat(a.related, ',', b.related), concat(a.rv, ',', b.rv), cast(a.changed as int) + cast(b.changed as int), greatest(a.risk, b.risk)
  from step a join step b on b.request_id = a.request_id and b.tv = a.tv and a.n = 2 and b.n = 2 and a.k = 1 and b.k = 2)
"""
RANKED_SQL = f"""
cx as (select c.*, r.requested, e.version as cur_t, c.changes + cast(c.tv <> e.version as int) as all_changes, {DIST.format('c.tv', 'r.requested')} as distance,
  cast(split_part(c.tv, '.', 1) as int) * 1000000 + cast(split_part(c.tv, '.', 2) as int) * 1000 + cast(split_part(c.tv, '.', 3) as int) as key_t,
  cast(split_part(e.version, '.', 1) as int) * 1000000 + cast(split_part(e.version, '.', 2) as int) * 1000 + cast(split_part(e.version, '.', 3) as int) as key_c
  from cand c join req r on r.request_id = c.request_id join env e on e.request_id = c.request_id and e.package = r.target),
cp as (select *, case when tv = requested then 0 when tv = cur_t then 1 when key_t < key_c then 3 else 2 end as priority from cx),
ranked as (select * from (select *, row_number() over (partition by request_id order by priority, all_changes, risk, distance, key_t, string_split(versions, ',')) as position from cp) where position <= 50)
"""


@query(
    "parse_requirements",
    "select request_id, package, case when request_id % 4 = 0 then null else version end as version from pins",
    "pins",
)
def _(t: Tables) -> DataFrame:
    """Requirement texts of the orders (a handful of lines each), with comments and options."""
    r = F.col("request_id")
    line = F.concat(
        F.lit(" "),
        F.regexp_replace("package", "-", "_"),
        F.when(r % 4 == 0, ">=").otherwise(" == "),
        F.col("version"),
        F.when(r % 3 == 0, ' ; python_version > "3"').otherwise(""),
    )
    texts = t.pins.groupBy("request_id").agg(
        F.concat(
            F.lit("# pins\r\n--no-index\n\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n")
        ).alias("requirements_text")
    )
    return adv.parse_requirements(texts).select("request_id", "package", "version")


@query(
    "validate_requests",
    """
with q as (select o_orderkey as id, o_custkey as c from orders),
p as (select request_id, package, count(*) as n from pins group by 1, 2),
k as (select request_id, count(*) as rows, min(package) as first_package from pins group by 1)
select 'unsupported_python' as rule, cast(id as varchar) as key from q where id % 9 = 0
union all select 'no_requirements', cast(id as varchar) from q where id not in (select request_id from k)
union all select 'not_exactly_pinned', cast(id as varchar) from q join k on request_id = id where id % 4 = 0
union all select 'target_absent', cast(id as varchar) from q join k on request_id = id where first_package <> 'brand-1'
union all select 'requested_version_missing', cast(id as varchar) from q where c % 5 = 0
union all select 'requested_version_invalid', cast(id as varchar) from q where c % 5 = 1
union all select 'duplicate_package', cast(request_id as varchar) from p where n > 1
""",
    "pins",
)
def _(t: Tables) -> DataFrame:
    c = F.col("o_custkey") % 5
    requests = t.orders.select(
        F.col("o_orderkey").alias("request_id"),
        F.when(F.col("o_orderkey") % 9 == 0, "2.7").otherwise("3.11").alias("python_version"),
        F.lit("Brand_1").alias("target_package"),
        F.when(c == 0, " ").when(c == 1, "not a version").otherwise("2.0").alias("requested_version"),
    )
    pins = t.pins.withColumn("version", F.when(F.col("request_id") % 4 != 0, F.col("version")))
    return adv.validate_requests(requests, pins).select("rule", "key")


@query(
    "environment_pairs",
    f"""
with {PAIR_SQL}, {REQUEST_SQL}
select a.request_id as env_id, a.package as "left", a.version as left_version, b.package as "right", b.version as right_version
from env a join env b on b.request_id = a.request_id and a.package < b.package join fam on lo = a.package and hi = b.package and fam.python_version = a.python_version
""",
    "releases families pins",
)
def _(t: Tables) -> DataFrame:
    families = adv.supported_families(scored_pairs(t))
    return adv.environment_pairs(environments_of(t), families).drop("python_version")


@query(
    "find_pair",
    f"""
with {PAIR_SQL}, {REQUEST_SQL},
p as (select a.request_id as env_id, a.python_version, a.package as l, a.version as lv, b.package as r, b.version as rv
  from env a join env b on b.request_id = a.request_id and a.package < b.package join fam on lo = a.package and hi = b.package and fam.python_version = a.python_version)
select env_id, l as "left", r as "right", coalesce(x.experiment_id, y.experiment_id) as experiment_id from p
left join f x on x.package_a = l and x.version_a = lv and x.package_b = r and x.version_b = rv and x.python_version = p.python_version
left join f y on y.package_b = l and y.version_b = lv and y.package_a = r and y.version_a = rv and y.python_version = p.python_version
""",
    "releases families pins",
)
def _(t: Tables) -> DataFrame:
    features = scored_pairs(t)
    pairs = adv.environment_pairs(environments_of(t), adv.supported_families(features))
    found = adv.find_pair(pairs, features)
    return found.select("env_id", "left", "right", "row.experiment_id")


@query(
    "pair_rows",
    f"""
with {PAIR_SQL}
select target, related, python_version, count(*) as row_count, count(distinct tv) as target_versions, min(rv) as first_related from o group by all
""",
    "releases families",
)
def _(t: Tables) -> DataFrame:
    return adv.pair_rows(scored_pairs(t)).groupBy("target", "related", "python_version").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_distinct("target_version").alias("target_versions"),
        F.min("related_version").alias("first_related"),
    )


def _oriented(t: Tables, pairs: DataFrame | None = None, pins: DataFrame | None = None):
    scored = (scored_pairs(t) if pairs is None else pairs).withColumn(
        "predicted_failure", F.coalesce("risk_detected", F.lit(False))
    )
    oriented = adv.pair_rows(
        scored, ["constraints_allow", "structured_probability", "predicted_failure"]
    )
    related = adv.related_packages(
        requests_of(t, pins), environments_of(t, pins), adv.supported_families(scored)
    )
    return materialize(related), oriented


@query(
    "common_target_versions",
    f"""
with {PAIR_SQL}, {REQUEST_SQL}, w as (select request_id, count(distinct related) as n from rel group by 1),
k as (select rel.request_id, o.tv, count(distinct rel.related) as found from rel
  join (select distinct target, related, python_version, tv from o) o on o.target = rel.target and o.related = rel.related and o.python_version = rel.python_version group by 1, 2)
select k.request_id, tv as target_version from k join w on w.request_id = k.request_id and n = found
""",
    "releases families pins",
)
def _(t: Tables) -> DataFrame:
    return adv.common_target_versions(*_oriented(t))


@query(
    "top_options",
    f"""
with {PAIR_SQL}, {REQUEST_SQL}, {OPTION_SQL}
select python_version, target, related, cur as current_version, tv as target_version, rv as related_version, cast(option as int) as option, distance, round(risk, 6) as risk from opt
""",
    "releases families pins",
)
def _(t: Tables) -> DataFrame:
    return adv.top_options(*_oriented(t)).drop("changed").withColumn("risk", F.round("risk", 6))


@query(
    "best_safe_option",
    f"""
with {PAIR_SQL}, {REQUEST_SQL},
k as (select g.*, o.tv, o.rv, o.risk, cast(split_part(rv, '.', 1) as int) * 1000000 + cast(split_part(rv, '.', 2) as int) * 1000 + cast(split_part(rv, '.', 3) as int) as kr,
  cast(split_part(cur, '.', 1) as int) * 1000000 + cast(split_part(cur, '.', 2) as int) * 1000 + cast(split_part(cur, '.', 3) as int) as kc
  from (select distinct python_version, target, related, cur from rel) g join o on o.target = g.target and o.related = g.related and o.python_version = g.python_version and o.allow and not o.warned),
n as (select *, row_number() over (partition by python_version, target, related, cur, tv order by rv <> cur, kr < kc, case when kr < kc then -kr else kr end, risk, rv) as rn from k)
select python_version, target, related, cur as current_version, tv as target_version, rv as related_version, round(risk, 6) as risk from n where rn = 1
""",
    "releases families pins",
)
def _(t: Tables) -> DataFrame:
    return adv.best_safe_option(*_oriented(t)).withColumn("risk", F.round("risk", 6))


@query(
    "expand_candidates",
    f"""
with {PAIR_SQL}, {REQUEST_SQL}, {OPTION_SQL}, {CANDIDATE_SQL}
select request_id, tv as target_version, packages, versions, changes as related_changes, round(risk, 6) as risk from cand
""",
    "releases families pins",
)
def _(t: Tables) -> DataFrame:
    related, oriented = _oriented(t)
    rows = adv.expand_candidates(related, adv.top_options(related, oriented))
    return _flat(rows)


def _flat(rows: DataFrame) -> DataFrame:
    return rows.withColumns(
        {
            "packages": F.array_join("packages", ","),
            "versions": F.array_join("versions", ","),
            "risk": F.round("risk", 6),
        }
    )


def ranked_of(t: Tables, pairs: DataFrame | None = None) -> DataFrame:
    pins = materialize(pins_of(t))
    related, oriented = _oriented(t, pairs, pins)
    return adv.best_candidates(
        related, adv.top_options(related, oriented), requests_of(t, pins), environments_of(t, pins)
    )


@query(
    "rank_candidates",
    f"""
with {PAIR_SQL}, {REQUEST_SQL}, {OPTION_SQL}, {CANDIDATE_SQL}, {RANKED_SQL}
select request_id, tv as target_version, versions, cast(position as int) as position, cast(priority as int) as priority, all_changes as changes, round(risk, 6) as risk, distance from ranked
""",
    "releases families pins",
)
def _(t: Tables) -> DataFrame:
    return _flat(ranked_of(t)).select(
        "request_id",
        "target_version",
        "versions",
        "position",
        F.col("priority").cast("int").alias("priority"),
        "changes",
        "risk",
        "distance",
    )


@query(
    "top_alternatives",
    f"""
with {PAIR_SQL}, {REQUEST_SQL}, {OPTION_SQL}, {CANDIDATE_SQL}, {RANKED_SQL},
b as (select request_id, tv, min(priority) as priority, min(all_changes) as changes, max(risk) as risk, min(distance) as distance from ranked group by 1, 2),
k as (select *, row_number() over (partition by request_id order by priority, changes, risk, distance, tv) as rn from b)
select request_id, tv as target_version, cast(rn as int) as position, round(risk, 6) as maximum_risk_score from k where rn <= 3
""",
    "releases families pins",
)
def _(t: Tables) -> DataFrame:
    per_version = ranked_of(t).groupBy("request_id", "target_version").agg(
        F.min("priority").alias("priority"),
        F.min("changes").alias("changes"),
        F.max("risk").alias("maximum_risk_score"),
        F.min("distance").alias("distance"),
    )
    best = adv.top_alternatives(per_version)
    return best.select(
        "request_id",
        "target_version",
        "position",
        F.round("maximum_risk_score", 6).alias("maximum_risk_score"),
    )


RISK_SQL = """
p as (select a.request_id as env_id, a.python_version, a.package as l, a.version as lv, b.package as r, b.version as rv, b.request_id % 5 <> 0 as ok, case when a.request_id % 7 = 0 then null else a.request_id % 5 <> 0 end as resolvable
  from env a join env b on b.request_id = a.request_id and a.package < b.package join fam on lo = a.package and hi = b.package and fam.python_version = a.python_version),
h as (select p.*, coalesce(x.experiment_id, y.experiment_id) is not null as covered, coalesce(x.allow, y.allow) as allow, coalesce(x.risk, y.risk) as risk, coalesce(x.i, y.i) as i, coalesce(x.s, y.s) as s, coalesce(x.combined, y.combined) as combined,
  coalesce(x.warned, y.warned) as warned, coalesce(resolvable, false) and coalesce(x.allow, y.allow) as usable from p
  left join f x on x.package_a = l and x.version_a = lv and x.package_b = r and x.version_b = rv and x.python_version = p.python_version
  left join f y on y.package_b = l and y.version_b = lv and y.package_a = r and y.version_a = rv and y.python_version = p.python_version),
er as (select env_id, count(*) as pairs, max(case when usable then combined end) as risk, count(case when usable then combined end) as covered_pairs, bool_or(coalesce(not allow, false)) as conflicts,
  bool_or(coalesce(usable and warned, false)) as warned, count(*) filter (where not covered or (usable and combined is null)) as warnings,
  coalesce(string_agg(distinct case when not covered then 'release_not_in_catalog' when usable and combined is null then 'release_without_vector' end
    || '|' || l || '==' || lv || '|' || r || '==' || rv || '|' || python_version, '; ' order by case when not covered then 'release_not_in_catalog' when usable and combined is null then 'release_without_vector' end
    || '|' || l || '==' || lv || '|' || r || '==' || rv || '|' || python_version), '') as distinct_warnings from h group by 1)
"""


def verdict_rows(t: Tables) -> DataFrame:
    """(env_id, resolvable): every fifth request is rejected, every seventh unknown."""
    r = F.col("request_id")
    return requests_of(t).select(
        r.alias("env_id"), F.when(r % 7 != 0, r % 5 != 0).alias("resolvable")
    )


@query(
    "environment_risk",
    f"""
with {PAIR_SQL}, {REQUEST_SQL}, {RISK_SQL}
select env_id, pairs, round(risk, 6) as maximum_post_install_risk, covered_pairs, conflicts as deterministic_conflicts, warned as post_install_risk_detected, warnings, distinct_warnings from er
""",
    "releases families pins",
)
def _(t: Tables) -> DataFrame:
    pairs = adv.assess_pairs(environments_of(t), scored_pairs(t), verdict_rows(t))
    return adv.environment_risk(pairs).withColumns(
        {
            "maximum_post_install_risk": F.round("maximum_post_install_risk", 6),
            "distinct_warnings": F.array_join("distinct_warnings", "; "),
        }
    )


@query(
    "pair_risk_order",
    f"""
with {PAIR_SQL}, {REQUEST_SQL}, {RISK_SQL},
k as (select *, case when not allow then 1.0 when usable and combined is not null then combined else risk end as score from h where covered)
select env_id, l as "left", r as "right", round(score, 6) as risk_score, cast(row_number() over (partition by env_id order by score desc, l, r) as int) as position from k
""",
    "releases families pins",
)
def _(t: Tables) -> DataFrame:
    pairs = adv.assess_pairs(environments_of(t), scored_pairs(t), verdict_rows(t))
    ranked = adv.pair_risk_order(pairs)
    return ranked.select(
        "env_id", "left", "right", F.round("risk_score", 6).alias("risk_score"), "position"
    )


@query(
    "advice_status",
    f"""
with {PAIR_SQL}, {REQUEST_SQL}, {RISK_SQL},
q as (select request_id as env_id, case when request_id % 7 = 0 then null else request_id % 5 <> 0 end as resolvable from req)
select q.env_id, case when resolvable is null then 'resolver_unavailable' when not resolvable or coalesce(conflicts, false) or coalesce(warned, false) then 'risk_found'
  when coalesce(covered_pairs, 0) < 1 then 'coverage_unavailable' else 'no_risk_predicted' end as status
from q left join er on er.env_id = q.env_id
""",
    "releases families pins",
)
def _(t: Tables) -> DataFrame:
    verdicts = verdict_rows(t)
    pairs = adv.assess_pairs(environments_of(t), scored_pairs(t), verdicts)
    status = adv.advice_status(verdicts.join(adv.environment_risk(pairs), "env_id", "left"))
    return status.select("env_id", "status")


@query(
    "join_resolution",
    """
with e as (select request_id, package, min(version) as version from pins group by 1, 2),
k as (select request_id as env_id, sha256(string_agg(concat(package, '==', version), chr(10) order by concat(package, '==', version))) as environment_key from e group by 1)
select env_id, environment_key, case when substr(environment_key, 1, 1) < '4' then null else substr(environment_key, 1, 1) < 'c' end as resolvable from k
""",
    "pins",
)
def _(t: Tables) -> DataFrame:
    environments = environments_of(t)
    keys = adv.environment_keys(environments).select("environment_key").distinct()
    first = F.substring("environment_key", 1, 1)
    verdicts = keys.filter(first >= "4").withColumn("resolvable", first < "c")
    return adv.join_resolution(environments, verdicts)


def verdict_table(t: Tables, pairs: DataFrame) -> DataFrame:
    """Verdicts of current and candidate environments: a function of the key, some unknown."""
    environments = environments_of(t)
    tried = adv.candidate_environments(ranked_of(t, pairs), environments)
    keys = adv.environment_keys(tried).unionByName(
        adv.environment_keys(environments.withColumn("env_id", F.col("env_id").cast("string")))
    )
    keys = keys.select("environment_key").distinct()
    first = F.substring("environment_key", 1, 1)
    return keys.filter(first >= "2").withColumn("resolvable", first < "d")


@query("advise")
def _(t: Tables) -> DataFrame:
    """The whole batch: status, recommendations and the reason when there is none."""
    requests, environments, scored = requests_of(t), environments_of(t), scored_pairs(t)
    verdicts = materialize(verdict_table(t, scored))
    status, accepted, warnings, _ = adv.advise(requests, environments, scored, verdicts)
    counts = accepted.groupBy("request_id").agg(F.count(F.lit(1)).alias("recommendations"))
    return (
        status.select(F.col("env_id").alias("request_id"), "status")
        .join(counts, "request_id", "left")
        .join(warnings.select("request_id", "considered", "warning"), "request_id", "left")
    )


@query(
    "recommend",
    f"""
with {PAIR_SQL}, {REQUEST_SQL}, {OPTION_SQL}, {CANDIDATE_SQL}, {RANKED_SQL},
a as (select request_id, position, risk, position % 4 = 2 as conflict, (request_id + position) % 3 <> 0 as resolvable from ranked where position <= 5),
k as (select *, row_number() over (partition by request_id order by position) as rn from a where not conflict and resolvable)
select request_id, cast(position as int) as position, cast(rn as int) as recommendation from k where rn <= 3
""",
    "releases families pins",
)
def _(t: Tables) -> DataFrame:
    # Read from both sides of a join; later positions are never checked.
    ranked = materialize(ranked_of(t).select("request_id", "position").filter(F.col("position") <= MAXIMUM_CHECKS))
    p, r = F.col("position"), F.col("request_id")
    assessments = ranked.select(
        "request_id",
        "position",
        (p % 4 == 2).alias("deterministic_conflicts"),
        ((r + p) % 3 != 0).alias("resolvable"),
        F.lit(1).alias("covered_pairs"),
        F.lit(False).alias("post_install_risk_detected"),
        F.lit(0).alias("warnings"),
        F.lit(0.1).alias("maximum_post_install_risk"),
    )
    chosen = adv.recommend(ranked, assessments)
    return chosen.select("request_id", "position", "recommendation")


@query(
    "constraint_conflicts",
    f"""
with {PAIR_SQL}
select experiment_id, package_a as declaring_package, package_b as dependency_package, version_b as dependency_version, case when b1 >= 2 then '<2' else '' end as blocking
from f where not allow
""",
    "releases families",
)
def _(t: Tables) -> DataFrame:
    rows = adv.constraint_conflicts(pair_features(t))
    return rows.select(
        "experiment_id",
        "declaring_package",
        "dependency_package",
        "dependency_version",
        F.array_join("blocking_specifiers", ",").alias("blocking"),
    )

