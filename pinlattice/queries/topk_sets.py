"""Top-k reports and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinlattice.operators import catalog as cat
from pinlattice.operators import observations as obs
from pinlattice.operators.violations import id_preview
from pinlattice.queries.adapters import Tables
from pinlattice.queries.joins import two_logs
from pinlattice.queries.registry import query
from pinlattice.queries.windows import KEY_SQL, ranking


@query(
    "largest_histories",
    "select package, count(distinct version) as releases from releases group by 1 order by 2 desc, 1 limit 10",
    "releases",
)
def _(t: Tables) -> DataFrame:
    return cat.largest_histories(t.releases, 10)


@query(
    "id_preview",
    """
with r as (select experiment_id, count(*) as n from observations group by 1),
a as (select 'missing' as kind, m.experiment_id from matrix m left join r on r.experiment_id = m.experiment_id where r.n is null
  union all select 'extra', r.experiment_id from r where r.experiment_id not in (select experiment_id from matrix)
  union all select 'duplicate', experiment_id from r where n > 1),
k as (select *, row_number() over (partition by kind order by experiment_id) as rn from a)
select kind, string_agg(experiment_id, ',' order by experiment_id) as preview from k where rn <= 100 group by kind
""",
    "observations matrix",
)
def _(t: Tables) -> DataFrame:
    preview = id_preview(obs.audit_ids(t.matrix, t.observations), "kind", "experiment_id")
    return preview.select("kind", F.array_join("preview", ",").alias("preview"))


TOP_SQL = """
r as (select concat(lower(c_mktsegment), '-', cast(c_custkey % 500 as varchar)) as package, c_custkey from customer where floor(c_acctbal) >= 0),
f as (select package, row_number() over (order by min(c_custkey)) as rank from r group by 1),
v as (select concat(lower(c_mktsegment), '-', cast(c_custkey % 500 as varchar)) as package, count(*) as releases
  from customer join orders on o_custkey = c_custkey where o_totalprice > 300000 group by 1),
s as (select f.package, f.rank, v.releases, row_number() over (order by f.rank) as position from f join v on v.package = f.package)
"""


def _top(t: Tables):
    versions = t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey")).filter(
        "o_totalprice > 300000"
    )
    named = versions.select(
        F.concat(F.lower("c_mktsegment"), F.lit("-"), (F.col("c_custkey") % 500).cast("string")).alias("package")
    )
    return cat.top_projects(cat.rank_projects(ranking(t)), named, 100)


@query(
    "top_projects",
    f"with {TOP_SQL} select package, rank, releases, cast(position as int) as position from s where position <= 100",
)
def _(t: Tables) -> DataFrame:
    return _top(t)[0].drop("download_count")


@query(
    "skipped_projects",
    f"""with {TOP_SQL} select package, rank from f where package not in (select package from v)
and rank < (select max(rank) from s where position <= 100)""",
)
def _(t: Tables) -> DataFrame:
    return _top(t)[1].select("package", "rank")


@query(
    "union_logs",
    """
with s as (select *, part_key % 2 as log from observations),
r as (select *, row_number() over (partition by experiment_id order by log, part_key, bytes) as rn from s)
select experiment_id, outcome, bytes from r where rn = 1
""",
    "observations",
)
def _(t: Tables) -> DataFrame:
    merged = obs.union_logs(two_logs(t), ["experiment_id"], ["part_key", "bytes"])
    return merged.select("experiment_id", "outcome", "bytes")


@query(
    "union_versions",
    f"""
with {KEY_SQL}, r as (select package, version, row_number() over (partition by package order by a desc, b desc, c desc) as rn from k)
select package, version from r where rn <= 5 union select package, version from releases where yanked
""",
    "releases",
)
def _(t: Tables) -> DataFrame:
    return cat.union_versions([cat.recent(t.releases, 5), t.releases.filter("yanked")])


@query(
    "except_ids",
    "select experiment_id from matrix except select experiment_id from observations",
    "observations matrix",
)
def _(t: Tables) -> DataFrame:
    return t.matrix.join(t.observations.select("experiment_id"), "experiment_id", "left_anti").distinct()


@query(
    "intersect_ids",
    "select experiment_id from matrix intersect select experiment_id from observations",
    "observations matrix",
)
def _(t: Tables) -> DataFrame:
    return t.matrix.intersect(t.observations.select("experiment_id"))


@query(
    "is_subset",
    """
select family, count(*) filter (where experiment_id not in (select experiment_id from matrix)) = 0 as subset,
  count(*) filter (where experiment_id not in (select experiment_id from matrix)) as outside
from observations group by family
""",
    "observations matrix",
)
def _(t: Tables) -> DataFrame:
    known = t.matrix.distinct().withColumn("known", F.lit(True))
    rows = t.observations.select("experiment_id", "family").join(known, "experiment_id", "left")
    return rows.groupBy("family").agg(
        (F.count_if(F.col("known").isNull()) == 0).alias("subset"),
        F.count_if(F.col("known").isNull()).alias("outside"),
    )
