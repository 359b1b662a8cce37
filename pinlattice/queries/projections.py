"""Column functions and row validation over the adapter views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinlattice.constants import PYTHON_VERSIONS
from pinlattice.functions import names, outcomes, requirements, scalars, text, vectors, versions, wheels
from pinlattice.operators import catalog as cat
from pinlattice.operators.matrix import validate_plan
from pinlattice.operators.observations import validate_manifest, validate_results
from pinlattice.plans.advisor import change_category, category_priority
from pinlattice.queries.adapters import Tables
from pinlattice.queries.registry import query

PYTHON_ROWS = "(select unnest(['3.8','3.9','3.10','3.11','3.12','3.13','3.14']) as python_version)"
MINOR = "cast(substr(python_version, 3) as int)"
# Whitespace of Unicode text written for RE2.
SPACE = r"[\s\x0b\x{85}\p{Z}]+"


def with_pythons(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "python_version", F.explode(F.array(*[F.lit(p) for p in PYTHON_VERSIONS]))
    )


@query(
    "parse_pin",
    """
with x as (select release_id, case when release_id % 13 = 0 then package when release_id % 13 = 1 then concat(package, '==')
  else concat(package, '==', version) end as pin from releases)
select release_id, case when length(split_part(pin, '==', 2)) > 0 then split_part(pin, '==', 1) end as name,
  case when length(split_part(pin, '==', 2)) > 0 then split_part(pin, '==', 2) end as version
from x
""",
    "releases",
)
def _(t: Tables) -> DataFrame:
    k = F.col("release_id") % 13
    pin = (
        F.when(k == 0, F.col("package"))
        .when(k == 1, F.concat("package", F.lit("==")))
        .otherwise(F.concat("package", F.lit("=="), "version"))
    )
    parsed = t.releases.select("release_id", names.parse_pin(pin).alias("p"))
    return parsed.select("release_id", "p.name", "p.version")


@query(
    "canonical_name",
    """
select p_partkey, trim(lower(regexp_replace(concat(p_brand, '__', p_name, '.-', p_type), '[-_.]+', '-', 'g'))) as name
from part
""",
)
def _(t: Tables) -> DataFrame:
    raw = F.concat("p_brand", F.lit("__"), "p_name", F.lit(".-"), "p_type")
    return t.part.select("p_partkey", names.canonical_name(raw).alias("name"))


@query(
    "experiment_id",
    """
select l_orderkey, l_linenumber, l_partkey,
  substr(sha256(concat_ws('|', concat('pkg-', cast(l_partkey as varchar)), concat(cast(l_linenumber as varchar), '.0'),
    concat('dep-', cast(l_suppkey as varchar)), '1.0', concat('3.', cast(8 + l_partkey % 7 as varchar)), 'linux', 'x86_64')), 1, 20) as experiment_id
from lineitem
""",
)
def _(t: Tables) -> DataFrame:
    text_ = lambda c: F.col(c).cast("string")
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        names.experiment_id(
            F.concat(F.lit("PKG-"), text_("l_partkey")),
            F.concat(text_("l_linenumber"), F.lit(".0")),
            F.concat(F.lit("dep-"), text_("l_suppkey")),
            F.lit("1.0"),
            F.concat(F.lit("3."), (8 + F.col("l_partkey") % 7).cast("string")),
        ).alias("experiment_id"),
    )


@query(
    "catalog_and_changelog_ids",
    """
select release_id, substr(sha256(concat_ws('|', package, version, '3.11', 'linux|x86_64|glibc')), 1, 20) as catalog_id,
  substr(sha256(concat_ws('|', package, version, 'changelog-v1.1')), 1, 20) as changelog_id
from releases
""",
    "releases",
)
def _(t: Tables) -> DataFrame:
    p, v = F.col("package"), F.col("version")
    return t.releases.select(
        "release_id",
        names.catalog_id(p, v, F.lit("3.11")).alias("catalog_id"),
        names.changelog_id(p, v).alias("changelog_id"),
    )


def _files(t: Tables) -> DataFrame:
    """File names with some that are no wheel names."""
    k = F.col("release_id") % 17
    return t.releases.withColumn(
        "filename",
        F.when(k == 0, F.concat("package", F.lit("-1.0.tar.gz")))
        .when(k == 1, F.concat("package", F.lit(".whl")))
        .otherwise(F.col("filename")),
    )


FILES_SQL = """case when release_id % 17 = 0 then concat(package, '-1.0.tar.gz')
  when release_id % 17 = 1 then concat(package, '.whl') else filename end"""


@query(
    "wheel_tags",
    f"""
with f as (select release_id, {FILES_SQL} as name from releases),
p as (select release_id, name, regexp_extract(name, '^(.*)-([^-]+)-([^-]+)-([^-]+)\\.whl$', ['x','python','abi','platform']) as g from f)
select release_id, nullif(g.python, '') as python, nullif(g.abi, '') as abi, nullif(g.platform, '') as platform,
  case when not name like '%.whl' then 'not a wheel filename' when g.python = '' then 'invalid wheel filename' end as reason
from p
""",
    "releases",
)
def _(t: Tables) -> DataFrame:
    tagged = _files(t).select("release_id", wheels.wheel_tags(F.col("filename")).alias("w"))
    return tagged.select("release_id", "w.python", "w.abi", "w.platform", "w.reason")


@query(
    "wheel_compatible",
    f"""
with f as (select release_id, {FILES_SQL} as name, python_version from releases, {PYTHON_ROWS})
select release_id, python_version,
  name like '%py3-none-any.whl' or name like '%cp38-abi3-manylinux%' or (name like '%cp311-cp311-manylinux%' and python_version = '3.11') as compatible,
  case when not name like '%.whl' then 'not a wheel filename'
    when not name like '%-%-%.whl' then 'invalid wheel filename'
    when name like '%win_amd64.whl' then 'platform tag is not glibc Linux x86_64'
    when name like '%py3-none-any.whl' then 'universal tag py3-none'
    when name like '%cp38-abi3%' and python_version = '3.8' then 'CPython 3.8 tag'
    when name like '%cp38-abi3%' then 'stable ABI from CPython 3.8'
    when python_version = '3.11' then 'CPython 3.11 tag'
    else 'Python/ABI tags do not match' end as reason
from f
""",
    "releases",
)
def _(t: Tables) -> DataFrame:
    fit = wheels.wheel_compatible(F.col("filename"), F.col("python_version"))
    rows = with_pythons(_files(t)).select("release_id", "python_version", fit.alias("w"))
    return rows.select("release_id", "python_version", "w.compatible", "w.reason")


@query(
    "requires_python_allows",
    f"""
with s as (select p_partkey, p_partkey % 9 as k, python_version, {MINOR} as m from part, {PYTHON_ROWS})
select p_partkey, python_version,
  case k when 0 then m >= 9 when 1 then m between 9 and 11 when 2 then true when 3 then m >= 10 when 4 then m <> 9
    when 5 then m = 11 when 6 then m >= 10 when 7 then m <= 11 else m >= 12 end as allowed
from s
""",
)
def _(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 9
    spec = (
        F.when(k == 0, ">=3.9")
        .when(k == 1, ">=3.9, <3.12")
        .when(k == 3, "~=3.10")
        .when(k == 4, "!=3.9.*")
        .when(k == 5, "==3.11.*")
        .when(k == 6, ">3.10")
        .when(k == 7, "<=3.12")
        .when(k == 8, ">=3.12,!=bogus")
    )
    rows = with_pythons(t.part.select("p_partkey", spec.alias("spec")))
    return rows.select(
        "p_partkey",
        "python_version",
        wheels.requires_python_allows(F.col("spec"), F.col("python_version")).alias("allowed"),
    )


def _suffixed(t: Tables) -> DataFrame:
    k = F.col("release_id") % 6
    suffix = (
        F.when(k == 0, ".post2").when(k == 1, "rc1").when(k == 2, ".dev3").when(k == 3, "-x-y")
    )
    return t.releases.withColumn("version", F.concat("version", F.coalesce(suffix, F.lit(""))))


SUFFIXED_SQL = """concat(version, case release_id % 6 when 0 then '.post2' when 1 then 'rc1' when 2 then '.dev3'
  when 3 then '-x-y' else '' end)"""


@query(
    "stable_version_key",
    f"""
with v as (select release_id, {SUFFIXED_SQL} as version from releases),
s as (select *, regexp_full_match(version, '[0-9]+(\\.[0-9]+){{1,3}}(\\.post[0-9]+)?') as stable from v)
select release_id, stable, case when stable then regexp_extract(version, '^([0-9.]*[0-9])', 1) end as release,
  case when stable then coalesce(try_cast(nullif(regexp_extract(version, 'post([0-9]+)$', 1), '') as bigint), -1) end as post
from s
""",
    "releases",
)
def _(t: Tables) -> DataFrame:
    key = versions.version_key(F.col("version"))
    return _suffixed(t).select(
        "release_id",
        versions.is_stable(F.col("version")).alias("stable"),
        F.array_join(key["release"].cast("array<string>"), ".").alias("release"),
        key["post"].alias("post"),
    )


@query(
    "pep440_stable",
    """
select release_id, release_id % 6 not in (1, 2, 3) as stable, release_id % 6 <> 3 as valid from releases
""",
    "releases",
)
def _(t: Tables) -> DataFrame:
    v = F.col("version")
    return _suffixed(t).select(
        "release_id",
        versions.pep440_stable(v).alias("stable"),
        versions.pep440_key(v).isNotNull().alias("valid"),
    )


@query(
    "pep440_order",
    f"""
with v as (select release_id, package, {SUFFIXED_SQL} as version, version as base, release_id % 6 as k from releases),
s as (select *, cast(split_part(base, '.', 1) as int) as a, cast(split_part(base, '.', 2) as int) as b, cast(split_part(base, '.', 3) as int) as c,
  case k when 2 then 0 when 1 then 1 when 0 then 3 else 2 end as phase from v where k <> 3),
r as (select *, row_number() over (partition by package order by a desc, b desc, c desc, phase desc, release_id desc) as rn from s)
select package, version as newest, release_id from r where rn = 1
""",
    "releases",
)
def _(t: Tables) -> DataFrame:
    key = versions.pep440_key(F.col("version"))
    valid = _suffixed(t).filter(key.isNotNull())
    best = valid.groupBy("package").agg(
        F.max_by(F.struct("version", "release_id"), F.struct(key, F.col("release_id"))).alias("b")
    )
    return best.select("package", F.col("b.version").alias("newest"), "b.release_id")


def projects(t: Tables) -> DataFrame:
    """Project payloads (info, releases map) assembled from the release view, one per package and version."""
    file = F.struct(
        F.lit("bdist_wheel").alias("packagetype"),
        "filename",
        F.concat(F.lit("https://files.test/"), "filename").alias("url"),
        F.col("release_id").alias("size"),
        F.struct(F.sha2("filename", 256).alias("sha256")).alias("digests"),
        F.concat(F.col("released").cast("string"), F.lit("T00:00:00Z")).alias("upload_time_iso_8601"),
        F.lit(None).cast("string").alias("upload_time"),
        "yanked",
        "requires_python",
    )
    per_release = t.releases.groupBy("package", "version").agg(F.collect_list(file).alias("files"))
    return per_release.select(
        F.struct(F.col("package").alias("name")).alias("info"), F.create_map("version", "files").alias("releases")
    )


def payloads(t: Tables) -> DataFrame:
    """Release payloads (info, urls): a release is yanked when its smallest id is a multiple of 7."""
    rows = projects(t).select(
        F.col("info.name").alias("name"), F.explode("releases").alias("version", "urls")
    )
    first = F.array_min(F.transform("urls", lambda u: u["size"]))
    empty = F.array().cast("array<string>")
    return rows.select(
        F.struct(
            "name",
            "version",
            F.array_max(F.transform("urls", lambda u: u["requires_python"])).alias("requires_python"),
            empty.alias("requires_dist"),
            empty.alias("provides_extra"),
            empty.alias("classifiers"),
            F.lit(None).cast("map<string,string>").alias("project_urls"),
            (first % 7 == 0).alias("yanked"),
        ).alias("info"),
        "urls",
    )


CUTOFF = "2023-06-30T00:00:00Z"


@query(
    "file_eligible",
    """
select package, version, count(*) as files,
  cast(count(*) filter (where not yanked and released <= date '2023-06-30') as bigint) as eligible
from releases group by package, version
""",
    "releases",
)
def _(t: Tables) -> DataFrame:
    files = cat.explode_project_files(projects(t))
    ok = cat.file_eligible(F.col("file"), scalars.parse_time(F.lit(CUTOFF)))
    return files.groupBy("package", "version").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(ok).alias("eligible")
    )


@query(
    "eligible_versions",
    """
select distinct package, version from releases
where not yanked and released <= date '2023-06-30' and (
  (filename like '%py3-none-any.whl') or
  (filename like '%cp311-cp311-manylinux%') or
  (filename like '%cp38-abi3-manylinux%'))
""",
    "releases",
)
def _(t: Tables) -> DataFrame:
    cutoff = scalars.parse_time(F.lit(CUTOFF))
    return cat.eligible_versions(projects(t), ["3.9", "3.10", "3.11"], cutoff)


@query(
    "published_versions",
    "select distinct package, version from releases where not yanked and released <= date '2023-06-30'",
    "releases",
)
def _(t: Tables) -> DataFrame:
    return cat.published_versions(projects(t), scalars.parse_time(F.lit(CUTOFF)))


AUDIT_SQL = f"""
with g as (select package, version, max(requires_python) as rp, min(release_id) % 7 = 0 as yanked from releases group by 1, 2),
w as (select r.package, r.version, r.yanked as file_yanked, r.filename, g.rp, g.yanked, p.python_version, {MINOR} as m
  from releases r join g on r.package = g.package and r.version = g.version cross join {PYTHON_ROWS} p),
a as (select package, version, python_version, max(rp) as rp, bool_or(yanked) as yanked, max(m) as m, count(*) as files,
  count(*) filter (where file_yanked) as yanked_files,
  count(*) filter (where not file_yanked and (rp is null or (rp = '>=3.9' and m >= 9) or (rp = '>=3.9,<3.12' and m between 9 and 11))
    and (filename like '%py3-none-any.whl' or filename like '%cp38-abi3-manylinux%' or (filename like '%cp311-cp311-manylinux%' and m = 11))) as compatible
  from w group by 1, 2, 3)
select package, version, python_version, not yanked and compatible > 0 as eligible,
  case when not yanked and compatible > 0 then 'eligible' when yanked then 'yanked_release'
    when not (rp is null or (rp = '>=3.9' and m >= 9) or (rp = '>=3.9,<3.12' and m between 9 and 11)) then 'requires_python_excluded'
    when files = yanked_files then 'all_wheels_yanked' else 'incompatible_wheel_tags' end as reason,
  cast(compatible as int) as compatible_wheels
from a
"""


def audited(t: Tables) -> DataFrame:
    return cat.audit_scope(cat.normalize_release(payloads(t), PYTHON_VERSIONS))


@query("coverage_reason", AUDIT_SQL, "releases")
def _(t: Tables) -> DataFrame:
    return audited(t)


@query(
    "selected_wheel",
    f"""
with g as (select package, version, max(requires_python) as rp from releases group by 1, 2),
w as (select r.package, r.version, r.yanked, r.filename, g.rp, p.python_version, {MINOR} as m
  from releases r join g on r.package = g.package and r.version = g.version cross join {PYTHON_ROWS} p),
ok as (select *, not yanked and (rp is null or (rp = '>=3.9' and m >= 9) or (rp = '>=3.9,<3.12' and m between 9 and 11))
    and (filename like '%py3-none-any.whl' or filename like '%cp38-abi3-manylinux%' or (filename like '%cp311-cp311-manylinux%' and m = 11)) as fits from w)
select package, version, python_version, min(filename) filter (where fits) as filename,
  cast(count(*) filter (where fits) as int) as eligible_wheels
from ok group by 1, 2, 3
""",
    "releases",
)
def _(t: Tables) -> DataFrame:
    w = F.col("release.wheels")
    return cat.normalize_release(payloads(t), PYTHON_VERSIONS).select(
        F.col("release.name").alias("package"),
        F.col("release.version").alias("version"),
        "python_version",
        wheels.selected_wheel(w)["filename"].alias("filename"),
        wheels.eligible_wheel_count(w).alias("eligible_wheels"),
    )


@query(
    "best_wheel",
    """
with c as (select package, version, filename, release_id,
  case when filename like '%any.whl' then 1 else 2 end as pr,
  case when filename like '%cp311%' then 3 when filename like '%abi3%' then 2 else 1 end as vr
  from releases where not filename like '%win_amd64.whl'),
r as (select *, row_number() over (partition by package, version order by pr desc, vr desc, filename desc) as rn from c),
k as (select distinct package, version from releases)
select k.package, k.version, r.filename, case when r.filename is null then 'no compatible wheel' end as violation
from k left join r on k.package = r.package and k.version = r.version and r.rn = 1
""",
    "releases",
)
def _(t: Tables) -> DataFrame:
    rows = payloads(t).select(
        F.col("info.name").alias("package"),
        F.col("info.version").alias("version"),
        F.transform(
            "urls",
            lambda u: F.struct(
                u["filename"].alias("name"),
                u["url"].alias("url"),
                u["size"].alias("size"),
                u["digests"]["sha256"].alias("sha256"),
            ),
        ).alias("wheels"),
    )
    best = rows.select("package", "version", wheels.best_wheel(F.col("wheels"), "3.11").alias("b"))
    return best.select("package", "version", F.col("b.wheel.name").alias("filename"), "b.violation")


@query(
    "validate_manifest",
    """
with m as (select concat(cast(l_orderkey as varchar), '-', cast(l_linenumber as varchar)) as id, l_partkey, l_suppkey, l_linenumber from lineitem),
v as (
  select 'unsupported_python' as rule, id as key, '' as detail from m where l_partkey % 9 in (7, 8)
  union all select 'unsupported_platform', id, '' from m where l_suppkey % 10 = 0
  union all select 'same_package', id, '' from m where l_partkey % 30 = l_suppkey % 30 and l_linenumber <> 3
  union all select 'invalid_pin', id, '' from m where l_linenumber = 3
  union all select 'duplicate_id', id, cast(count(*) as varchar) from m group by id having count(*) > 1)
select rule, key, detail from v
""",
)
def _(t: Tables) -> DataFrame:
    s = lambda c: c.cast("string")
    rows = t.lineitem.select(
        F.concat(s(F.col("l_orderkey")), F.lit("-"), s(F.col("l_linenumber"))).alias("experiment_id"),
        F.concat(F.lit("Pkg."), s(F.col("l_partkey") % 30), F.lit("==1.0")).alias("package_a"),
        F.concat(
            F.lit("pkg-"),
            s(F.col("l_suppkey") % 30),
            F.when(F.col("l_linenumber") == 3, "=1.0").otherwise("==1.0"),
        ).alias("package_b"),
        F.concat(F.lit("3."), s(8 + F.col("l_partkey") % 9)).alias("python"),
        F.when(F.col("l_suppkey") % 10 == 0, "win_amd64").otherwise("linux_x86_64").alias("platform"),
    )
    return validate_manifest(rows)


@query(
    "validate_results",
    """
with o as (select experiment_id, outcome, part_key,
  case when part_key % 19 = 0 then 'other' else experiment_id end as calculated from observations)
select 'id_mismatch' as rule, experiment_id as key, '' as detail from o where calculated <> experiment_id
union all select 'unmeasured_outcome', experiment_id, '' from o where outcome = 'infrastructure_failure'
union all select 'not_measured', experiment_id, '' from o where part_key % 23 = 0
""",
    "observations",
)
def _(t: Tables) -> DataFrame:
    rows = t.observations.select(
        "experiment_id",
        "outcome",
        F.when(F.col("part_key") % 19 == 0, "other")
        .otherwise(F.col("experiment_id"))
        .alias("calculated_id"),
        (F.col("part_key") % 23 != 0).alias("measured"),
    )
    return validate_results(rows)


def plan_packages(t: Tables) -> DataFrame:
    n = F.regexp_extract("package", r"(\d+)$", 1).cast("int")
    split = F.when(n % 3 == 0, "development").when(n % 3 == 1, "validation").otherwise("final_test")
    return t.releases.select("package").distinct().select(
        "package",
        F.when(n % 8 == 0, "").otherwise("library").alias("role"),
        F.when(n % 11 == 0, "elsewhere").otherwise(split).alias("split"),
        F.when(n % 5 == 0, 1).otherwise(3).alias("minimum_versions"),
    )


PLAN_SQL = """
p as (select package, n, case when n % 8 = 0 then '' else 'library' end as role,
  case when n % 11 = 0 then 'elsewhere' when n % 3 = 0 then 'development' when n % 3 = 1 then 'validation' else 'final_test' end as split,
  case when n % 5 = 0 then 1 else 3 end as minimum_versions
  from (select distinct package, cast(regexp_extract(package, '([0-9]+)$', 1) as int) as n from releases))
"""


@query(
    "validate_plan",
    f"""
with {PLAN_SQL}
select 'invalid_split' as rule, package as key, '' as detail from p where split = 'elsewhere'
union all select 'missing_role', package, '' from p where role = ''
union all select 'minimum_versions', package, '' from p where minimum_versions < 2
union all select 'crosses_splits', f.family, '' from families f join p a on a.package = f.package_a join p b on b.package = f.package_b
  where a.split <> f.split or b.split <> f.split
union all select 'unused_package', package, '' from p
  where package not in (select package_a from families) and package not in (select package_b from families)
""",
    "releases families",
)
def _(t: Tables) -> DataFrame:
    return validate_plan(plan_packages(t), t.families, 3, 12)


REQUIREMENT_SQL = """
r as (select release_id, version, release_id % 8 as k,
  cast(split_part(version, '.', 1) as int) * 1000000 + cast(split_part(version, '.', 2) as int) * 1000 + cast(split_part(version, '.', 3) as int) as v
  from releases)
"""


def requirement_rows(t: Tables) -> DataFrame:
    k = F.col("release_id") % 8
    requirement = (
        F.when(k == 0, "Dep.Name>=1.2,<2")
        .when(k == 1, "dep-name (<2.0,>=0.15)")
        .when(k == 2, "dep_name==2.*")
        .when(k == 3, 'dep-name[extra]~=1.4; extra == "x"')
        .when(k == 4, "dep-name!=1.5.1")
        .when(k == 5, "dep-name")
        .when(k == 6, "dep-name @@ broken")
    )
    return t.releases.select("release_id", "version", requirement.alias("requirement"))


@query(
    "direct_requirement",
    f"""
with {REQUIREMENT_SQL}
select release_id, case k when 0 then 'Dep.Name>=1.2,<2' when 1 then 'dep-name (<2.0,>=0.15)' when 2 then 'dep_name==2.*'
  when 3 then 'dep-name[extra]~=1.4; extra == "x"' when 4 then 'dep-name!=1.5.1' when 5 then 'dep-name'
  when 6 then 'dep-name @@ broken' else 'dep-name>0' end as requirement
from r
""",
    "releases",
)
def _(t: Tables) -> DataFrame:
    declared = F.array_compact(
        F.array(F.lit("other>=1"), F.col("requirement"), F.lit("dep-name>0"))
    )
    return requirement_rows(t).select(
        "release_id",
        requirements.direct_requirement(declared, F.lit("DEP_name")).alias("requirement"),
    )


@query(
    "requirement_bounds",
    f"""
with {REQUIREMENT_SQL}
select release_id, k in (0, 1) as has_upper, k in (0, 1) as has_lower, k = 2 as has_exact from r
""",
    "releases",
)
def _(t: Tables) -> DataFrame:
    bounds = requirements.requirement_bounds(F.col("requirement"))
    return requirement_rows(t).select("release_id", bounds.alias("b")).select("release_id", "b.*")


@query(
    "requirement_allows",
    f"""
with {REQUIREMENT_SQL}
select release_id, case k when 0 then v >= 1002000 and v < 2000000 when 1 then v < 2000000 and v >= 15000
  when 2 then v // 1000000 = 2 when 3 then v >= 1004000 and v < 2000000 when 4 then v <> 1005001 when 5 then true end as allowed
from r
""",
    "releases",
)
def _(t: Tables) -> DataFrame:
    return requirement_rows(t).select(
        "release_id",
        requirements.requirement_allows(F.col("requirement"), F.col("version")).alias("allowed"),
    )


@query(
    "version_parts",
    f"""
with v as (select release_id, regexp_extract_all({SUFFIXED_SQL}, '([0-9]+)') as n from releases)
select release_id, cast(n[1] as bigint) as major, cast(n[2] as bigint) as minor, cast(n[3] as bigint) as patch from v
""",
    "releases",
)
def _(t: Tables) -> DataFrame:
    parts = _suffixed(t).select("release_id", versions.version_parts(F.col("version")).alias("p"))
    return parts.select("release_id", "p.*")


@query(
    "release_dates",
    """
with e as (select event_id, epoch_us(ts) as a, epoch_us(timestamp '2024-01-15 12:00:00') as c, ts from events)
select event_id, cast(abs(floor((a - c) / 86400000000.0)) as bigint) as distance,
  cast(date_diff('day', date '1970-01-01', cast(ts as date)) + 719163 as bigint) as ordinal,
  greatest(floor((c - a) / 86400000000.0), 0.0) as age
from e
""",
)
def _(t: Tables) -> DataFrame:
    ts, cutoff = F.col("ts").cast("timestamp"), F.lit("2024-01-15 12:00:00").cast("timestamp")
    return t.events.select(
        "event_id",
        scalars.release_distance(ts, cutoff).alias("distance"),
        scalars.release_ordinal(ts).cast("bigint").alias("ordinal"),
        scalars.release_age(ts, cutoff).alias("age"),
    )


@query(
    "outcome_labels",
    """
select outcome, case when outcome = 'pass' then 'compatible' else 'incompatible' end as compatibility_label,
  outcome = 'pass' as is_compatible, outcome <> 'pass' as is_failure,
  case when outcome = 'pass' then 'pass' when outcome = 'resolution_failure' then 'resolution' else 'post_install' end as failure_stage,
  outcome <> 'resolution_failure' as resolution_succeeded, outcome in ('pass', 'smoke_test_failure') as imports_succeeded,
  count(*) as row_count
from observations group by all
""",
    "observations",
)
def _(t: Tables) -> DataFrame:
    labelled = t.observations.select("outcome", *outcomes.outcome_labels(F.col("outcome")))
    return labelled.groupBy(*labelled.columns).agg(F.count(F.lit(1)).alias("row_count"))


def errors(t: Tables) -> DataFrame:
    k = F.col("part_key") % 6
    message = (
        F.when(k == 0, "ValueError: numpy.dtype size changed, may be broken")
        .when(k == 1, "ImportError: cannot import name 'soft_unicode'")
        .when(k == 2, "ImportError: cannot import name 'url_quote'")
        .when(k == 3, "ImportError: cannot import name 'other'")
        .when(k == 4, "boom")
    )
    return t.observations.withColumn("normalized_error", message)


@query(
    "failure_category",
    """
with e as (select outcome, part_key % 6 as k from observations)
select outcome, case when outcome = 'pass' then null when outcome = 'resolution_failure' then 'declared_dependency_resolution_conflict'
    when k = 0 then 'numpy_binary_abi_incompatibility' when k = 1 then 'removed_markupsafe_soft_unicode_api'
    when k = 2 then 'removed_werkzeug_url_quote_api' when outcome = 'smoke_test_failure' then 'interoperability_behavior_failure'
    else 'other_failure' end as category,
  case k when 0 then 'NumPy binary ABI: dtype size changed' when 1 then 'Removed MarkupSafe API: soft_unicode'
    when 2 then 'Removed Werkzeug API: url_quote' when 3 then 'Other removed import API' else 'Other import failure' end as pattern,
  count(*) as row_count
from e group by all
""",
    "observations",
)
def _(t: Tables) -> DataFrame:
    o, e = F.col("outcome"), F.col("normalized_error")
    rows = errors(t).select(
        "outcome",
        outcomes.failure_category(o, e).alias("category"),
        outcomes.import_pattern(e).alias("pattern"),
    )
    return rows.groupBy("outcome", "category", "pattern").agg(F.count(F.lit(1)).alias("row_count"))


def stage_rows(t: Tables) -> DataFrame:
    """Recorded stage logs whose failing stage follows from the line's columns."""

    def stage(name, exit_code, stdout=F.lit(""), stderr=F.lit(""), timed_out=F.lit(False)):
        return F.struct(
            F.lit(name).alias("stage"),
            F.array(F.lit("tool")).alias("command"),
            exit_code.cast("int").alias("exit_code"),
            F.col("l_tax").alias("duration_seconds"),
            stdout.alias("stdout"),
            stderr.alias("stderr"),
            timed_out.alias("timed_out"),
            F.col("l_partkey").alias("peak_rss_bytes"),
        )

    line, flag = F.col("l_linenumber"), F.col("l_returnflag")
    zero = F.lit(0)
    resolve_failed = flag == "R"
    smoke_failed = (flag == "N") & (line >= 4)
    stages = F.array_compact(
        F.array(
            stage("create_environment", zero, timed_out=line == 1),
            F.when(
                line != 1,
                stage(
                    "resolve_artifacts",
                    resolve_failed.cast("int"),
                    stdout=F.when(line == 2, "disk full").otherwise("No solution found"),
                ),
            ),
            F.when(
                (line != 1) & ~resolve_failed,
                stage("install_exact_artifacts", ((flag == "A") & (line == 3)).cast("int")),
            ),
            F.when(
                (line != 1) & ~resolve_failed & ~((flag == "A") & (line == 3)),
                stage("capture_environment", zero),
            ),
            F.when(
                (line != 1) & ~resolve_failed & ~((flag == "A") & (line == 3)),
                stage(
                    "smoke_test",
                    smoke_failed.cast("int"),
                    stdout=F.when(line == 5, '{"stage": "imports_passed"}').otherwise(""),
                    stderr=F.lit("Traceback\nkit.LoadError: no\nValueError"),
                ),
            ),
            stage("cleanup_environment", (F.col("l_suppkey") % 9 == 0).cast("int")),
        )
    )
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_returnflag",
        "l_suppkey",
        stages.alias("stages"),
        (F.col("l_partkey") % 31 != 0).alias("wheels_available"),
    )


@query(
    "classify_stages",
    """
with c as (select case when l_partkey % 31 = 0 then 'wheel_unavailable' when l_linenumber = 1 then 'timeout'
  when l_returnflag = 'R' then case when l_linenumber = 2 then 'infrastructure_failure' else 'resolution_failure' end
  when l_returnflag = 'A' and l_linenumber = 3 then 'installation_failure'
  when l_returnflag = 'N' and l_linenumber >= 4 then case when l_linenumber = 5 then 'smoke_test_failure' else 'import_failure' end
  when l_suppkey % 9 = 0 then 'infrastructure_failure' else 'pass' end as outcome,
  case when l_linenumber > 1 and l_returnflag = 'N' and l_linenumber >= 4 then 'ValueError' end as exception_type
from lineitem)
select outcome, exception_type, count(*) as row_count from c group by all
""",
)
def _(t: Tables) -> DataFrame:
    rows = stage_rows(t).select(
        outcomes.classify_stages(F.col("stages"), F.col("wheels_available")).alias("c")
    )
    return rows.groupBy("c.outcome", "c.exception_type").agg(F.count(F.lit(1)).alias("row_count"))


@query(
    "normalize_error",
    f"""
with d as (select doc_id, trim(regexp_replace(concat(text, ' /tmp/run/.venv/lib ', text), '{SPACE}', ' ', 'g')) as flat from documents),
c as (select doc_id, left(regexp_replace(flat, '/[^ ]*/\\.venv', '<venv>', 'g'), 2000) as error from d)
select doc_id, error from c
""",
)
def _(t: Tables) -> DataFrame:
    log = F.concat("text", F.lit(" /tmp/run/.venv/lib "), "text")
    return t.documents.select("doc_id", outcomes.normalize_error(log).alias("error"))


@query(
    "exception_type",
    """
select event_id, case when user_id % 3 = 0 then 'pkg.mod.TimeoutException' when user_id % 3 = 1 then 'KeyError' end as exception_type
from events
""",
)
def _(t: Tables) -> DataFrame:
    k = F.col("user_id") % 3
    log = F.concat(
        F.lit("Traceback:\n  OSError: indented\n"),
        F.when(k == 0, "KeyError: 1\npkg.mod.TimeoutException\n  done")
        .when(k == 1, "KeyError: 'x'\nnot a NameError: here")
        .otherwise("fine"),
    )
    return t.events.select("event_id", outcomes.exception_type(log).alias("exception_type"))


def declared_rows(t: Tables) -> DataFrame:
    """Declared directions and three-valued allowances derived from line keys."""
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    return t.lineitem.select(
        (p % 2 == 0).alias("da"),
        F.when(p % 3 == 0, True).when(p % 3 == 1, False).alias("aa"),
        (s % 2 == 0).alias("db"),
        F.when(s % 3 == 0, True).when(s % 3 == 1, False).alias("ab"),
    )


DECLARED_SQL = """
d as (select l_partkey % 2 = 0 as da, case l_partkey % 3 when 0 then true when 1 then false end as aa,
  l_suppkey % 2 = 0 as db, case l_suppkey % 3 when 0 then true when 1 then false end as ab from lineitem)
"""


@query(
    "constraint_state",
    f"""
with {DECLARED_SQL},
s as (select *, (da and aa is not null) or (db and ab is not null) as known,
  coalesce(da and not aa, false) or coalesce(db and not ab, false) as blocked from d)
select da, aa, db, ab, blocked, known and not blocked as allows, not known as unknown, cast(da as int) + cast(db as int) as edges, count(*) as row_count
from s group by all
""",
)
def _(t: Tables) -> DataFrame:
    state = requirements.constraint_state(*[F.col(c) for c in ("da", "aa", "db", "ab")])
    rows = declared_rows(t).withColumn("s", state).select("da", "aa", "db", "ab", "s.*")
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("row_count"))


@query(
    "constraints_allow",
    f"""
with {DECLARED_SQL}
select da, aa, db, ab, (not da or coalesce(aa, false)) and (not db or coalesce(ab, false)) as allow, count(*) as row_count
from d group by all
""",
)
def _(t: Tables) -> DataFrame:
    allow = requirements.constraints_allow(*[F.col(c) for c in ("da", "aa", "db", "ab")])
    rows = declared_rows(t).withColumn("allow", allow)
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("row_count"))


@query(
    "blocking_clauses",
    f"""
with {REQUIREMENT_SQL}
select release_id, concat_ws(' | ',
  case when k = 0 and v < 1002000 then '>=1.2' end, case when k = 0 and v >= 2000000 then '<2' end,
  case when k = 1 then null end, case when k = 2 then '==2.*' end,
  case when k = 4 and v = 1005001 then '!=1.5.1' end) as blocking
from r
""",
    "releases",
)
def _(t: Tables) -> DataFrame:
    bare = F.trim(F.get(F.split(F.coalesce("requirement", F.lit("")), ";", 2), F.lit(0)))
    blocking = requirements.blocking_clauses(bare, F.col("version"))
    return requirement_rows(t).select(
        "release_id", F.array_join(blocking, " | ").alias("blocking")
    )


@query(
    "to_bool_and_number",
    """
with x as (select o_orderkey, o_orderkey % 6 as k, o_totalprice from orders)
select o_orderkey, case k when 0 then true when 1 then false end as flag, case when k > 1 then 'not a boolean' end as violation,
  case k when 0 then 1.0 when 1 then 0.0 when 2 then o_totalprice else -1.0 end as number
from x
""",
)
def _(t: Tables) -> DataFrame:
    k = F.col("o_orderkey") % 6
    raw = (
        F.when(k == 0, " TRUE ")
        .when(k == 1, "False")
        .when(k == 2, F.col("o_totalprice").cast("string"))
        .when(k == 3, "n/a")
        .when(k == 4, "nan")
    )
    rows = t.orders.select("o_orderkey", raw.alias("raw"))
    flag = scalars.to_bool(F.col("raw"))
    return rows.select(
        "o_orderkey",
        flag["value"].alias("flag"),
        flag["violation"].alias("violation"),
        scalars.to_number(F.col("raw"), -1.0).alias("number"),
    )


@query(
    "version_distance",
    """
with p as (select release_id, cast(split_part(version, '.', 1) as bigint) as a, cast(split_part(version, '.', 2) as bigint) as b,
  cast(split_part(version, '.', 3) as bigint) as c from releases)
select release_id, abs(a - 1) * 1000000 + abs(b - 4) * 1000 + abs(c - 2) as distance from p
""",
    "releases",
)
def _(t: Tables) -> DataFrame:
    return t.releases.select(
        "release_id",
        versions.version_distance(F.col("version"), F.lit("1.4.2rc1")).alias("distance"),
    )


@query(
    "change_category",
    """
with p as (select release_id, version, cast(split_part(version, '.', 1) as bigint) * 1000000 + cast(split_part(version, '.', 2) as bigint) * 1000
  + cast(split_part(version, '.', 3) as bigint) as v from releases),
c as (select release_id, case when version = '2.4.1' then 'achieves_requested_change' when version = '1.5.0' then 'keeps_current_version'
  when v < 1005000 then 'downgrade_fallback' else 'different_upgrade_fallback' end as category from p)
select release_id, category, case category when 'achieves_requested_change' then 0 when 'keeps_current_version' then 1
  when 'different_upgrade_fallback' then 2 else 3 end as priority
from c
""",
    "releases",
)
def _(t: Tables) -> DataFrame:
    category = change_category(F.col("version"), F.lit("2.4.1"), F.lit("1.5.0"))
    return t.releases.select(
        "release_id",
        category.alias("category"),
        category_priority(category).cast("int").alias("priority"),
    )


@query(
    "release_document",
    """
with n as (select doc_id, source, text from documents),
b as (select doc_id, concat_ws(chr(10), concat('Package: ', source), concat('Release version: ', cast(doc_id as varchar)),
  concat('Requires Python: ', case when doc_id % 3 = 0 then 'not declared' else '>=3.9' end), 'Release date: unknown', 'Published dependencies:',
  case when doc_id % 2 = 0 then 'none declared' else concat('a>=', cast(doc_id as varchar), chr(10), 'b<2') end,
  'Relevant classifiers:', case when doc_id % 5 = 0 then 'none' else concat('Operating System :: Linux', chr(10), 'Topic :: Data') end,
  'Frozen release notes:', case when doc_id % 7 = 0 then 'No version-pinned changelog text is available; rely on published metadata.' else text end) as doc
  from n)
select doc_id, sha256(concat(regexp_replace(doc, '^[\\s\\x0b\\x{85}\\p{Z}]+|[\\s\\x0b\\x{85}\\p{Z}]+$', '', 'g'), chr(10))) as document_sha256 from b
""",
)
def _(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    none = F.lit(None).cast("array<string>")
    document = text.release_document(
        F.col("source"),
        d.cast("string"),
        F.when(d % 3 != 0, ">=3.9"),
        F.lit(None).cast("string"),
        F.when(d % 2 == 0, none).otherwise(
            F.array(F.lit("b<2"), F.concat(F.lit("a>="), d.cast("string")))
        ),
        F.when(d % 5 == 0, F.array(F.lit("License :: Free"))).otherwise(
            F.array(F.lit("Topic :: Data"), F.lit("License :: Free"), F.lit("Operating System :: Linux"))
        ),
        F.when(d % 7 != 0, F.col("text")),
    )
    return t.documents.select("doc_id", F.sha2(document, 256).alias("document_sha256"))


@query(
    "text_hash_check",
    "select page_id, page_id % 5 <> 0 as matches from pages",
)
def _(t: Tables) -> DataFrame:
    stored = F.sha2(
        F.when(F.col("page_id") % 5 == 0, F.concat("html", F.lit(" "))).otherwise(F.col("html")), 256
    )
    rows = t.pages.select("page_id", "html", F.upper(stored).alias("stored"))
    return rows.select(
        "page_id", text.text_hash_matches(F.col("html"), F.col("stored")).alias("matches")
    )


@query(
    "l2_normalize",
    """
with e as (select vec_id, list_transform(embedding, lambda x: case when vec_id % 10 = 0 then 0.0 else cast(x as double) end) as v from embeddings),
n as (select vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as length from e)
select vec_id, case when length = 0 then 'vector is zero' end as violation,
  case when length > 0 then round(list_sum(list_transform(v, lambda x: x / length)), 6) end as total,
  case when length > 0 then round(v[1] / length, 6) end as first_value
from n
""",
)
def _(t: Tables) -> DataFrame:
    v = F.transform(
        "embedding", lambda x: F.when(F.col("vec_id") % 10 == 0, 0.0).otherwise(x.cast("double"))
    )
    rows = t.embeddings.select("vec_id", vectors.l2_normalize(v).alias("n"))
    unit = F.col("n.vector")
    return rows.select(
        "vec_id",
        F.col("n.violation").alias("violation"),
        F.round(F.aggregate(unit, F.lit(0.0), lambda s, x: s + x), 6).alias("total"),
        F.round(F.get(unit, F.lit(0)), 6).alias("first_value"),
    )


@query(
    "changelog_urls",
    """
with p as (select release_id, version, split_part(version, '.', 1) as a, split_part(version, '.', 2) as b, split_part(version, '.', 3) as c from releases),
u as (select release_id, 'exact' as role, concat('https://notes.test/', a, '.', b, '/', version, '?tag=v', a, '.', lpad(b, 2, '0'), '.', c) as url from p where cast(a as int) >= 1
  union all select release_id, 'series_baseline', concat('https://notes.test/', a, '.', b, '/', a, '.', b, '.0?tag=v', a, '.', lpad(b, 2, '0'), '.', c) from p where cast(a as int) >= 1 and c <> '0'
  union all select release_id, 'major_baseline', concat('https://notes.test/', a, '.', b, '/', a, '.0.0?tag=v', a, '.', lpad(b, 2, '0'), '.', c) from p
    where cast(a as int) >= 2 and b <> '0'
  union all select release_id, 'exact', concat('https://old.test/', a, '.', b, '.0') from p where cast(a as int) < 1)
select release_id, role, url from u
""",
    "releases",
)
def _(t: Tables) -> DataFrame:
    urls = text.changelog_urls(
        F.col("version"),
        F.lit("https://notes.test/{major_minor}/{note_version}?tag={tag}"),
        F.lit("v{padded_version}"),
        F.lit(True),
        F.lit(2),
        F.lit("1.0.0"),
        F.lit("https://old.test/{series_version}"),
    )
    # A release table is a small file that one task would read: rows are dealt out before the work.
    return t.releases.repartition("release_id").select("release_id", F.explode(urls).alias("u")).select("release_id", "u.*")


@query(
    "chunk_starts",
    """
with d as (select doc_id, cast(n_chars as int) as n from documents)
select doc_id, case when n <= 510 then '0' when ceil(n / 510.0) <= 4
  then array_to_string(list_transform(generate_series(0, cast(ceil(n / 510.0) as int) - 1), lambda i: i * 510), ',')
  else array_to_string(list_sort(list_distinct(list_transform(generate_series(0, 3), lambda i: cast(round_even(i * (n - 510) / 3.0, 0) as int)))), ',') end as starts
from d
""",
)
def _(t: Tables) -> DataFrame:
    starts = text.chunk_starts(F.col("n_chars").cast("int"), 510, 4)
    return t.documents.select(
        "doc_id", F.array_join(starts.cast("array<string>"), ",").alias("starts")
    )


@query(
    "truncate_tokens",
    f"""
with d as (select doc_id, list_filter(regexp_split_to_array(text, '{SPACE}'), lambda x: x <> '') as w from documents)
select doc_id, cast(len(w) as int) as n_tokens, cast(least(len(w), 128) as int) as kept, len(w) > 128 as truncated,
  sha256(array_to_string(w[1:128], ' ')) as kept_sha256
from d
""",
)
def _(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", text.truncate_tokens(F.col("text"), 128).alias("t"))
    return rows.select(
        "doc_id",
        "t.n_tokens",
        "t.kept",
        "t.truncated",
        F.sha2(F.array_join("t.tokens", " "), 256).alias("kept_sha256"),
    )
