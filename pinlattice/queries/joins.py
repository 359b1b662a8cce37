"""Joins over the adapter views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinlattice.constants import PYTHON_VERSIONS
from pinlattice.operators import matrix as mx
from pinlattice.operators import observations as obs
from pinlattice.operators.catalog import catalog_consistency
from pinlattice.operators.metrics import merge_one_to_one, score_join
from pinlattice.operators.models import join_embeddings, missing_embeddings
from pinlattice.operators.texts import (
    embedding_problems,
    resume_guard,
    reuse_embeddings,
    signal_reproduction,
)
from pinlattice.plans.features import assert_unseen, join_results
from pinlattice.queries.adapters import Tables
from pinlattice.queries.projections import AUDIT_SQL, audited
from pinlattice.queries.registry import query
from pinlattice.session import materialize


def scope_of(t: Tables) -> DataFrame:
    """Scope rows of all Python targets in a listed version order."""
    scope = audited(t)
    # The audited scope is a stored table: it is read once per side and per count.
    return materialize(scope.withColumn("version_order", F.col("version")))


SCOPE_SQL = f"scope as (select * from ({AUDIT_SQL}))"
MATRIX_SQL = """
m as (select f.family, f.split, f.package_a, a.version as version_a, f.package_b, b.version as version_b, a.python_version,
  a.eligible and b.eligible as eligible, a.reason as reason_a, b.reason as reason_b,
  substr(sha256(concat_ws('|', f.package_a, a.version, f.package_b, b.version, a.python_version, 'linux', 'x86_64')), 1, 20) as experiment_id
  from families f join scope a on a.package = f.package_a join scope b on b.package = f.package_b and b.python_version = a.python_version)
"""


def numbered_of(t: Tables) -> DataFrame:
    """Runnable rows with their order."""
    return mx.numbered_matrix(scope_of(t), t.families, runnable_only=True)


def matrix_of(t: Tables, runnable_only: bool = False) -> DataFrame:
    return mx.experiment_matrix(scope_of(t), t.families, runnable_only)


@query(
    "experiment_matrix",
    f"""
with {SCOPE_SQL}, {MATRIX_SQL}
select family, python_version, eligible, count(*) as row_count, min(experiment_id) as first_id, max(experiment_id) as last_id
from m group by all
""",
    "releases families",
)
def _(t: Tables) -> DataFrame:
    return matrix_of(t).groupBy("family", "python_version", "eligible").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min("experiment_id").alias("first_id"),
        F.max("experiment_id").alias("last_id"),
    )


@query(
    "split_coverage",
    f"""
with {SCOPE_SQL}, {MATRIX_SQL}
select 'runnable' as part, family, '' as reason_a, '' as reason_b, count(*) as row_count from m where eligible group by all
union all select 'excluded', family, reason_a, reason_b, count(*) from m where not eligible group by all
""",
    "releases families",
)
def _(t: Tables) -> DataFrame:
    runnable, excluded = mx.split_coverage(matrix_of(t))
    empty = F.lit("")
    left = runnable.select(
        F.lit("runnable").alias("part"), "family", empty.alias("reason_a"), empty.alias("reason_b")
    )
    right = excluded.select(F.lit("excluded").alias("part"), "family", "reason_a", "reason_b")
    both = left.unionByName(right)
    return both.groupBy(*both.columns).agg(F.count(F.lit(1)).alias("row_count"))


@query(
    "join_results",
    """
with r as (select experiment_id, count(*) as n, min(outcome) as outcome, bool_and(part_key % 23 <> 0) as measured from observations group by 1),
j as (select matrix.experiment_id, r.n, r.outcome, r.measured from matrix left join r on r.experiment_id = matrix.experiment_id)
select rule, count(*) as row_count from (
  select case when n = 1 and measured then concat('joined ', outcome) end as rule from j
  union all select case when n is null then 'missing_result' end from j
  union all select case when n > 1 then 'duplicate_result' end from j
  union all select case when not measured then 'unmeasured_result' end from j)
where rule is not null group by rule
""",
    "observations matrix",
)
def _(t: Tables) -> DataFrame:
    results = t.observations.withColumn("measured", F.col("part_key") % 23 != 0)
    rows, problems = join_results(t.matrix, results)
    named = rows.select(F.concat(F.lit("joined "), "outcome").alias("rule"))
    return named.unionByName(problems.select("rule")).groupBy("rule").agg(
        F.count(F.lit(1)).alias("row_count")
    )


@query(
    "pending",
    """
select experiment_id from matrix where experiment_id not in
  (select experiment_id from observations where outcome <> 'infrastructure_failure')
""",
    "observations matrix",
)
def _(t: Tables) -> DataFrame:
    return obs.pending(t.matrix, t.observations)


def two_logs(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = t.observations.select(
        "experiment_id", "outcome", "duration_seconds", "bytes", "part_key"
    )
    first = rows.filter(F.col("part_key") % 2 == 0)
    return first, rows.filter(F.col("part_key") % 2 == 1)


@query(
    "seed_results",
    """
with s as (select experiment_id, outcome, duration_seconds, bytes, part_key, part_key % 2 as log from observations),
r as (select *, row_number() over (partition by experiment_id order by log, part_key, bytes) as rn from s)
select r.experiment_id, outcome, bytes from r where rn = 1 and experiment_id in (select experiment_id from matrix)
""",
    "observations matrix",
)
def _(t: Tables) -> DataFrame:
    rows, _ = obs.seed_results(t.matrix, two_logs(t), ["part_key", "bytes"])
    return rows.select("experiment_id", "outcome", "bytes")


@query(
    "seed_problems",
    """
with s as (select experiment_id, outcome, duration_seconds, bytes, part_key from observations)
select 'outside_matrix' as rule, experiment_id as key from s where experiment_id not in (select experiment_id from matrix) group by 2
union all select 'conflicting_rows', experiment_id from s group by 2
  having count(distinct concat_ws('|', outcome, duration_seconds, bytes, part_key)) > 1
""",
    "observations matrix",
)
def _(t: Tables) -> DataFrame:
    _, problems = obs.seed_results(t.matrix, two_logs(t), ["part_key", "bytes"])
    return problems.select("rule", "key")


@query(
    "seed_summary",
    """
with r as (select experiment_id, count(*) as n from observations group by 1)
select count(*) as matrix_experiments, cast(sum(coalesce(n, 0)) as bigint) as source_rows, count(n) as output_rows,
  count(*) - count(n) as remaining
from matrix left join r on r.experiment_id = matrix.experiment_id
""",
    "observations matrix",
)
def _(t: Tables) -> DataFrame:
    return obs.seed_summary(t.matrix, t.observations)


@query(
    "audit_ids",
    """
with r as (select experiment_id, count(*) as n from observations group by 1)
select 'missing' as kind, m.experiment_id from matrix m left join r on r.experiment_id = m.experiment_id where r.n is null
union all select 'extra', r.experiment_id from r where r.experiment_id not in (select experiment_id from matrix)
union all select 'duplicate', experiment_id from r where n > 1
""",
    "observations matrix",
)
def _(t: Tables) -> DataFrame:
    return obs.audit_ids(t.matrix, t.observations)


def vector_table(t: Tables) -> DataFrame:
    return t.embeddings.select(
        F.concat(F.lit("Label."), F.col("label").cast("string")).alias("package"),
        F.col("vec_id").cast("string").alias("version"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        F.sha2(F.col("vec_id").cast("string"), 256).alias("selected_text_sha256"),
        F.lit("hashing").alias("model"),
    )


def vector_pairs(t: Tables) -> DataFrame:
    """Every vector with its successor; the last one has no partner."""
    return t.embeddings.select(
        F.col("vec_id").cast("string").alias("experiment_id"),
        F.concat(F.lit("label_"), F.col("label").cast("string")).alias("package_a_name"),
        F.col("vec_id").cast("string").alias("package_a_version"),
        F.concat(F.lit("label-"), ((F.col("label") + 1) % 10).cast("string")).alias("package_b_name"),
        (F.col("vec_id") + 1).cast("string").alias("package_b_version"),
    )


@query(
    "join_embeddings",
    """
select cast(a.vec_id as varchar) as experiment_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: cast(z[1] as double) * z[2])), 6) as dot
from embeddings a join embeddings b on b.vec_id = a.vec_id + 1 and b.label = (a.label + 1) % 10
""",
)
def _(t: Tables) -> DataFrame:
    from pinlattice.functions.vectors import dot

    joined = join_embeddings(vector_pairs(t), vector_table(t))
    return joined.select(
        "experiment_id", F.round(dot(F.col("vector_a"), F.col("vector_b")), 6).alias("dot")
    )


@query(
    "missing_embeddings",
    """
with w as (select concat('label-', cast((label + 1) % 10 as varchar)) as package, cast(vec_id + 1 as varchar) as version from embeddings)
select distinct package, version from w where not exists
  (select 1 from embeddings e where concat('label-', cast(e.label as varchar)) = w.package and cast(e.vec_id as varchar) = w.version)
""",
)
def _(t: Tables) -> DataFrame:
    return missing_embeddings(vector_pairs(t), vector_table(t))


@query(
    "embedding_problems",
    """
select 'duplicate_release' as rule, concat('pkg-', cast(label as varchar), '==', cast(vec_id % 40 as varchar)) as key from embeddings group by label, vec_id % 40 having count(*) > 1
union all select 'mixed_model', 'table'
union all select 'invalid_vector', concat('pkg-', cast(label as varchar), '==', cast(vec_id % 40 as varchar)) from embeddings where vec_id % 10 = 0
""",
)
def _(t: Tables) -> DataFrame:
    rows = t.embeddings.select(
        F.concat(F.lit("pkg-"), F.col("label").cast("string")).alias("package"),
        (F.col("vec_id") % 40).cast("string").alias("version"),
        F.transform(
            "embedding", lambda x: F.when(F.col("vec_id") % 10 == 0, 0.0).otherwise(x)
        ).alias("embedding"),
        F.when(F.col("vec_id") % 50 == 3, "other").otherwise("hashing").alias("model"),
    )
    return embedding_problems(rows).select("rule", "key")


@query(
    "merge_one_to_one",
    """
with a as (select doc_id, quality from labels), b as (select doc_id, n_chars from documents)
select cast(doc_id as varchar) as key, 'merged' as rule from a join b using (doc_id)
union all select cast(l_orderkey as varchar), 'duplicate_right_key' from lineitem group by l_orderkey having count(*) > 1
""",
)
def _(t: Tables) -> DataFrame:
    merged, _ = merge_one_to_one(t.labels, t.documents.select("doc_id", "n_chars"), "doc_id")
    orders = t.orders.select(F.col("o_orderkey").alias("key"))
    lines = t.lineitem.select(F.col("l_orderkey").alias("key"))
    _, problems = merge_one_to_one(orders, lines, "key")
    return merged.select(
        F.col("doc_id").cast("string").alias("key"), F.lit("merged").alias("rule")
    ).unionByName(problems.select("key", "rule"))


@query(
    "score_join",
    """
with r as (select experiment_id, min(outcome) as outcome from observations group by 1),
j as (select matrix.experiment_id as p, r.experiment_id as q, r.outcome from matrix full join r on r.experiment_id = matrix.experiment_id)
select rule, count(*) as row_count from (
  select concat('scored ', outcome) as rule from j where p is not null and q is not null
  union all select 'prediction_missing' from j where p is null
  union all select 'result_missing' from j where q is null
  union all select 'outcome_not_evaluable' from j where outcome = 'infrastructure_failure') group by rule
""",
    "observations matrix",
)
def _(t: Tables) -> DataFrame:
    results = t.observations.groupBy("experiment_id").agg(F.min("outcome").alias("outcome"))
    rows, problems = score_join(t.matrix, results)
    named = rows.select(F.concat(F.lit("scored "), "outcome").alias("rule"))
    return named.unionByName(problems.select("rule")).groupBy("rule").agg(
        F.count(F.lit(1)).alias("row_count")
    )


@query(
    "assert_unseen",
    """
with d as (select distinct p_brand, p_partkey % 10 as v from part join lineitem on l_partkey = p_partkey where l_linenumber = 7),
s as (select distinct p_brand, p_partkey % 10 as v from part join lineitem on l_partkey = p_partkey where l_linenumber = 1 and l_quantity > 40)
select 'release_seen_in_training' as rule, concat(lower(replace(p_brand, '#', '#')), '==', cast(v as varchar)) as key from d where exists (select 1 from s where s.p_brand = d.p_brand and s.v = d.v)
union all select 'release_seen_in_training', 'other==1'
""",
)
def _(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("package_a"),
        (F.col("p_partkey") % 10).cast("string").alias("version_a"),
        F.lit("other").alias("package_b"),
        F.lit("1").alias("version_b"),
        "l_linenumber",
        "l_quantity",
    )
    seen = assert_unseen(
        rows.filter("l_linenumber = 7"), rows.filter("l_linenumber = 1 and l_quantity > 40")
    )
    return seen.select("rule", "key")


def page_evidence(t: Tables) -> DataFrame:
    return t.pages.select(
        F.regexp_extract("url", r"//([^/]+)/", 1).alias("package"),
        F.col("page_id").cast("string").alias("version"),
        F.sha2("html", 256).alias("selected_text_sha256"),
        "page_id",
    )


def page_vectors(t: Tables) -> DataFrame:
    """Stored vectors of the pages, some made from another text or by another model."""
    p = F.col("page_id")
    return page_evidence(t).select(
        "package",
        "version",
        F.when(p % 7 == 0, F.sha2("version", 256))
        .otherwise(F.col("selected_text_sha256"))
        .alias("selected_text_sha256"),
        F.when(p % 11 == 0, "old").otherwise("hashing").alias("model"),
        F.when(p % 13 == 0, F.array(F.lit(1.0)))
        .otherwise(F.array(F.lit(0.6), F.lit(0.8)))
        .alias("embedding"),
        "page_id",
    )


@query(
    "reuse_embeddings",
    "select page_id from pages where page_id % 7 <> 0 and page_id % 11 <> 0 and page_id % 3 <> 0",
)
def _(t: Tables) -> DataFrame:
    done = page_evidence(t).filter("page_id % 3 = 0")
    return reuse_embeddings(page_evidence(t), page_vectors(t), done, "hashing").select("page_id")


@query(
    "resume_guard",
    """
with e as (select page_id, concat(regexp_extract(url, '//([^/]+)/', 1), '==', cast(page_id as varchar)) as key from pages)
select 'text_changed' as rule, key from e where page_id % 7 = 0 and page_id % 5 <> 0
union all select 'other_model', key from e where page_id % 11 = 0
union all select 'other_width', key from e where page_id % 13 = 0
union all select 'not_in_source', key from e where page_id % 5 = 0
""",
)
def _(t: Tables) -> DataFrame:
    source = page_evidence(t).filter("page_id % 5 <> 0")
    return resume_guard(page_vectors(t), source, "hashing", 2).select("rule", "key")


@query(
    "split_disjoint",
    """
select package, min(split) as first_split, max(split) as last_split
from (select package_a as package, split from families union all select package_b, split from families)
group by package having min(split) <> max(split)
""",
    "families",
)
def _(t: Tables) -> DataFrame:
    f = t.families
    rows = f.select(F.explode(F.array("package_a", "package_b")).alias("package"), "split")
    return mx.split_disjoint(rows, "package")


@query(
    "environment_equals",
    """
with o as (select o_orderkey from orders),
p as (select distinct l_orderkey, l_partkey % 40 as a, l_partkey % 3 as v from lineitem),
q as (select distinct l_orderkey, l_partkey % 40 as a, case when l_tax > 0.07 then 9 else l_partkey % 3 end as v from lineitem),
x as (select l_orderkey, string_agg(concat(a, '=', v), ',' order by a, v) as s from p group by 1),
y as (select l_orderkey, string_agg(concat(a, '=', v), ',' order by a, v) as s from q group by 1)
select o_orderkey, coalesce(x.s, '') = coalesce(y.s, '') as same from o left join x on x.l_orderkey = o_orderkey left join y on y.l_orderkey = o_orderkey
""",
)
def _(t: Tables) -> DataFrame:
    """One order is one installed environment (a handful of pins per order)."""
    name = F.concat(F.lit("Pkg_"), (F.col("l_partkey") % 40).cast("string"))
    version = (F.col("l_partkey") % 3).cast("string")
    installed = F.when(F.col("l_tax") > 0.07, "9").otherwise(version)
    sets = t.lineitem.groupBy("l_orderkey").agg(
        F.collect_set(F.struct(name.alias("package"), version.alias("version"))).alias("artifacts"),
        F.collect_set(
            F.concat(F.lower(F.replace(name, F.lit("_"), F.lit("."))), F.lit("=="), installed)
        ).alias("environment"),
    )
    joined = t.orders.select("o_orderkey").join(
        sets, F.col("o_orderkey") == F.col("l_orderkey"), "left"
    )
    return joined.select(
        "o_orderkey",
        obs.environment_equals(F.col("artifacts"), F.col("environment")).alias("same"),
    )


@query(
    "top_level_equals",
    """
select l_orderkey, l_linenumber, l_partkey, l_tax <= 0.05 as same, case when l_discount > 0.05 then l_partkey else l_suppkey end as size from lineitem
""",
)
def _(t: Tables) -> DataFrame:
    def wheel(name: str, digest, size, top_level=None):
        fields = [F.lit(name).alias("filename"), digest.alias("sha256"), size.alias("size")]
        if top_level is not None:
            fields.append(F.lit(top_level).alias("top_level"))
        return F.struct(*fields)

    h = F.sha2(F.col("l_partkey").cast("string"), 256)
    stored = F.when(F.col("l_tax") <= 0.05, F.upper(h)).otherwise("changed")
    missing = F.when(F.col("l_discount") <= 0.05, F.col("l_suppkey"))
    artifacts = F.array(
        wheel("b.whl", h, F.col("l_suppkey"), True),
        wheel("a.whl", stored, missing, True),
        wheel("c.whl", h, F.col("l_suppkey"), False),
    )
    selected = F.array(wheel("a.whl", h, F.col("l_partkey")), wheel("b.whl", h, F.col("l_suppkey")))
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", artifacts.alias("x"), selected.alias("y")
    )
    filled = obs.fill_top_level_sizes(F.col("x"), F.col("y"))
    return rows.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        obs.top_level_equals(F.col("x"), F.col("y")).alias("same"),
        F.get(filled, F.lit(1))["size"].alias("size"),
    )


@query(
    "runtime_pilot",
    f"""
with {SCOPE_SQL}, {MATRIX_SQL},
r as (select *, row_number() over (partition by python_version order by version_a desc, version_b desc) as rn from m
  where eligible and package_a = 'brand-7' and package_b = 'brand-8'),
y as (select unnest(['3.8', '3.9', '3.10', '3.11', '3.12', '3.13', '3.14', '3.15']) as python_version)
select y.python_version, r.experiment_id, r.version_a, r.version_b, r.experiment_id is null as missing
from y left join r on r.python_version = y.python_version and r.rn = 1
""",
    "releases families",
)
def _(t: Tables) -> DataFrame:
    pythons = t.spark.createDataFrame([(p,) for p in (*PYTHON_VERSIONS, "3.15")], "python_version string")
    return mx.runtime_pilot(scope_of(t), t.families, "brand-7", "brand-8", pythons)


@query(
    "signal_reproduction",
    """
select cast(doc_id as varchar) as version, 'n_chars' as field, cast(n_chars as varchar) as stored, cast(length(text) as varchar) as recomputed from documents where n_chars <> length(text)
union all select cast(doc_id as varchar), 'lines', cast(case when doc_id % 9 = 0 then 0 else len(string_split(text, chr(10))) end as varchar), cast(len(string_split(text, chr(10))) as varchar)
from documents where doc_id % 9 = 0
""",
)
def _(t: Tables) -> DataFrame:
    version = F.col("doc_id").cast("string").alias("version")
    lines = F.size(F.split("text", "\n"))
    stored = t.documents.select(
        version, "n_chars", F.when(F.col("doc_id") % 9 == 0, 0).otherwise(lines).alias("lines")
    )
    again = t.documents.select(version, F.length("text").alias("n_chars"), lines.alias("lines"))
    return signal_reproduction(stored, again, ["version"], ["n_chars", "lines"])


@query(
    "catalog_consistency",
    """
select package, version, count(*) as rows from releases group by 1, 2
having count(distinct concat(coalesce(requires_python, 'null'), '|', cast(yanked as varchar))) > 1
""",
    "releases",
)
def _(t: Tables) -> DataFrame:
    return catalog_consistency(
        t.releases, ["package", "version"], ["requires_python", "yanked"]
    )
