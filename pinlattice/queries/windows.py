"""Ranks, shards, folds, selections and ordered contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinlattice.functions.text import evidence_lines, select_section
from pinlattice.operators import catalog as cat
from pinlattice.operators import matrix as mx
from pinlattice.operators import metrics as met
from pinlattice.operators import observations as obs
from pinlattice.operators.folds import balanced_fold_map, family_folds, fold_summary
from pinlattice.queries.adapters import Tables
from pinlattice.queries.aggregates import DOC_PATTERNS, SCORED_SQL, duck_pattern, scored
from pinlattice.queries.joins import MATRIX_SQL, SCOPE_SQL, numbered_of
from pinlattice.queries.registry import query
from pinlattice.streaming import conversations as conv

KEY_SQL = """
k as (select package, version, cast(split_part(version, '.', 1) as int) as a, cast(split_part(version, '.', 2) as int) as b, cast(split_part(version, '.', 3) as int) as c
  from (select distinct package, version from releases))
"""
RANK_SQL = f"""
{KEY_SQL}, r as (select *, row_number() over (partition by package order by a, b, c) - 1 as rank, count(*) over (partition by package) as n from k)
"""


@query(
    "release_rank",
    f"""
with {RANK_SQL}
select package, version, rank, n as releases, round(rank / greatest(n - 1, 1), 9) as percentile, rank = n - 1 as is_latest from r
""",
    "releases",
)
def _(t: Tables) -> DataFrame:
    return cat.release_rank(t.releases).withColumn("percentile", F.round("percentile", 9))


@query(
    "matrix_order",
    f"""
with {SCOPE_SQL}, {MATRIX_SQL}
select experiment_id, row_number() over (order by family, cast(substr(python_version, 3) as int), version_a, version_b, experiment_id) as matrix_order
from m where eligible
""",
    "releases families",
)
def _(t: Tables) -> DataFrame:
    return numbered_of(t).select("experiment_id", "matrix_order")


@query(
    "shards",
    f"""
with {SCOPE_SQL}, {MATRIX_SQL},
o as (select experiment_id, row_number() over (order by family, cast(substr(python_version, 3) as int), version_a, version_b, experiment_id) as rn,
  cast(ceil(count(*) over () / 100.0) as int) as shard_count from m where eligible),
s as (select *, cast(floor((rn - 1) / 100) + 1 as int) as shard_index from o)
select shard_index, shard_count, concat('shard-', lpad(cast(shard_index as varchar), cast(greatest(2, length(cast(shard_count as varchar))) as int), '0'),
  '-of-', lpad(cast(shard_count as varchar), cast(greatest(2, length(cast(shard_count as varchar))) as int), '0')) as shard_name, count(*) as row_count, min(experiment_id) as first_id
from s group by all
""",
    "releases families",
)
def _(t: Tables) -> DataFrame:
    return mx.assign_shards(numbered_of(t), 100).groupBy("shard_index", "shard_count", "shard_name").agg(
        F.count(F.lit(1)).alias("row_count"), F.min("experiment_id").alias("first_id")
    )


@query(
    "first_wins",
    """
with r as (select *, row_number() over (partition by experiment_id order by part_key, bytes) as rn from observations)
select experiment_id, outcome, bytes from r where rn = 1
""",
    "observations",
)
def _(t: Tables) -> DataFrame:
    rows = t.observations.select("experiment_id", "outcome", "bytes", "part_key")
    return obs.first_wins(rows, ["experiment_id"], ["part_key", "bytes"]).drop("part_key")


@query(
    "conflicting_results",
    """
select experiment_id, count(*) as rows from observations group by 1 having count(distinct outcome) > 1
""",
    "observations",
)
def _(t: Tables) -> DataFrame:
    return obs.conflicts(t.observations.select("experiment_id", "outcome"), ["experiment_id"])


@query(
    "repair_results",
    """
select experiment_id, min(outcome) as outcome, min(bytes) as bytes from observations group by 1
having count(*) = 1 and min(outcome) <> 'infrastructure_failure'
""",
    "observations",
)
def _(t: Tables) -> DataFrame:
    return obs.repair_results(t.observations.select("experiment_id", "outcome", "bytes"))


@query(
    "repair_summary",
    """
with g as (select experiment_id, count(*) as n, bool_or(outcome = 'infrastructure_failure') as infra from observations group by 1)
select cast(sum(n) as bigint) as input_rows, count(*) as input_unique_ids, count(*) filter (where n > 1) as duplicate_ids,
  count(*) filter (where n = 1 and infra) as infrastructure_only_ids, count(*) filter (where n = 1 and not infra) as output_rows
from g
""",
    "observations",
)
def _(t: Tables) -> DataFrame:
    return obs.repair_summary(t.observations)


@query(
    "recent_versions",
    f"""
with {KEY_SQL}, r as (select package, version, row_number() over (partition by package order by a desc, b desc, c desc) as recency from k)
select package, version, recency from r where recency <= 5
""",
    "releases",
)
def _(t: Tables) -> DataFrame:
    return cat.recent(t.releases, 5)


@query(
    "average_rank",
    f"""
with {SCORED_SQL}
select experiment_id, part_key, bytes, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as average_rank from s
""",
    "observations",
)
def _(t: Tables) -> DataFrame:
    ranked = met.rank_rows(scored(t), "score")
    return ranked.select("experiment_id", "part_key", "bytes", "average_rank")


@query(
    "precision_at_rank",
    """
with r as (select family, doc_id, row_number() over w as rank, sum(actual) over (w rows unbounded preceding) as p from labelled
  window w as (partition by family order by score desc, doc_id))
select family, doc_id, rank, round(cast(p as double) / rank, 9) as precision from r
""",
    "labelled",
)
def _(t: Tables) -> DataFrame:
    rows = met.precision_at_rank(t.labelled, "score", ["doc_id"], by=["family"])
    return rows.select("family", "doc_id", "rank", F.round("precision", 9).alias("precision"))


def release_notes(t: Tables) -> DataFrame:
    """Each text becomes a history whose headings are placed between its lines."""
    lines = F.split("text", "\n")
    d = F.col("doc_id") % 10
    title = lambda a, b: F.concat(F.lit("## Version "), a.cast("string"), F.lit(b), F.lit(" ##"))
    return t.documents.select(
        "doc_id",
        F.concat(d.cast("string"), F.lit(".2.1")).alias("version"),
        F.array_join(
            F.concat(
                F.array(F.lit("History"), title(d + 1, ".0.0")),
                F.array(F.get(lines, F.lit(0)), title(d, ".2.1")),
                lines,
                F.array(F.concat(d.cast("string"), F.lit(".2.0")), F.lit("------"), F.lit("older fix")),
                F.array(title(d, ".1.9"), F.lit("last")),
            ),
            "\n",
        ).alias("text"),
    )


@query(
    "select_section",
    r"""
with d as (select doc_id, cast(doc_id % 10 as varchar) as d, text from documents)
select doc_id, true as found, sha256(regexp_replace(concat('## Version ', d, '.2.1 ##', chr(10), array_to_string(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]'), chr(10)), chr(10), d, '.2.0', chr(10), '------', chr(10), 'older fix'), '^[\s\x0b\x{85}\p{Z}]+|[\s\x0b\x{85}\p{Z}]+$', '', 'g')) as section_sha256
from d
""",
)
def _(t: Tables) -> DataFrame:
    found = release_notes(t).select(
        "doc_id", select_section(F.col("text"), F.col("version")).alias("s")
    )
    return found.select(
        "doc_id", "s.found", F.sha2("s.section", 256).alias("section_sha256")
    )


def _evidence_sql() -> str:
    patterns = [p for group in DOC_PATTERNS.values() for p in group]
    matches = " or ".join(f"regexp_matches(w, '{duck_pattern(p)}')" for p in patterns)
    return f"""
with l as (select doc_id, unnest(s) as raw, generate_subscripts(s, 1) as i
  from (select doc_id, regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') as s from documents)),
n as (select doc_id, i, trim(regexp_replace(raw, '[\\s\\x0b\\x{{85}}\\p{{Z}}]+', ' ', 'g'), ' -*#`' || chr(9)) as line from l),
w as (select doc_id, i, line, regexp_replace(lower(line), '([^\\p{{L}}\\p{{M}}\\p{{Nd}}_])', '\\1\\1', 'g') as w from n where length(line) >= 12),
k as (select doc_id, i, left(line, 180) as line, row_number() over (partition by doc_id order by i) as rn from w where {matches})
select doc_id, cast(rn - 1 as int) as position, line from k where rn <= 8
"""


@query("evidence_lines", _evidence_sql())
def _(t: Tables) -> DataFrame:
    return t.documents.select(
        "doc_id", F.posexplode(evidence_lines(F.col("text"), DOC_PATTERNS)).alias("position", "line")
    )


def ranking(t: Tables) -> DataFrame:
    """Download counts per customer segment and nation, with bad rows and name variants."""
    return t.customer.select(
        F.concat(
            F.lower("c_mktsegment"),
            F.when(F.col("c_custkey") % 2 == 0, "-").otherwise("__"),
            (F.col("c_custkey") % 500).cast("string"),
        ).alias("project"),
        F.floor("c_acctbal").alias("download_count"),
        F.col("c_custkey").cast("int").alias("listed"),
    ).filter(F.col("download_count") >= 0)


@query(
    "rank_projects",
    """
with r as (select concat(lower(c_mktsegment), '-', cast(c_custkey % 500 as varchar)) as package, cast(floor(c_acctbal) as bigint) as n, c_custkey from customer where floor(c_acctbal) >= 0),
f as (select package, arg_min(n, c_custkey) as download_count, min(c_custkey) as listed from r group by 1)
select package, download_count, row_number() over (order by listed) as rank from f
""",
)
def _(t: Tables) -> DataFrame:
    return cat.rank_projects(ranking(t))


@query(
    "recent_turns",
    """
with r as (select *, row_number() over (partition by conv_id order by turn desc) as rn from conversations),
f as (select conv_id, turn, concat('[', case when role = 'user' then 'user' else 'assistant' end, '] ', left(trim(text), 1200)) as line from r where rn <= 8)
select conv_id, count(*) as turns, string_agg(line, chr(10) order by turn) as context from f group by conv_id
""",
)
def _(t: Tables) -> DataFrame:
    return conv.recent_turns(t.conversations)


@query(
    "family_folds",
    """
with f as (select family, dense_rank() over (order by family) as i from (select distinct family from observations))
select o.family, cast((i - 1) % 4 + 1 as int) as fold, count(*) as row_count from observations o join f on f.family = o.family group by all
""",
    "observations",
)
def _(t: Tables) -> DataFrame:
    folded = family_folds(t.observations.select("family"), 4)
    return folded.groupBy("family", "fold").agg(F.count(F.lit(1)).alias("row_count"))


@query(
    "balanced_folds",
    """
with recursive c as (select family, cast(count(*) as double) as n, cast(sum(case when outcome = 'pass' then 0 else 1 end) as double) as f from observations group by 1),
o as (select *, row_number() over (order by n desc, f desc, family) as i, sum(n) over () / 3 as gn, greatest(1.0, sum(f) over () / 3) as gf from c),
g as (select 0 as i, cast('' as varchar) as family, 0 as fold, 0.0::double as n1, 0.0::double as n2, 0.0::double as n3, 0.0::double as f1, 0.0::double as f2, 0.0::double as f3, 0 as c1, 0 as c2, 0 as c3
  union all
  select cast(o.i as int), o.family, x.k, g.n1 + case x.k when 1 then o.n else 0 end, g.n2 + case x.k when 2 then o.n else 0 end, g.n3 + case x.k when 3 then o.n else 0 end,
    g.f1 + case x.k when 1 then o.f else 0 end, g.f2 + case x.k when 2 then o.f else 0 end, g.f3 + case x.k when 3 then o.f else 0 end,
    g.c1 + cast(x.k = 1 as int), g.c2 + cast(x.k = 2 as int), g.c3 + cast(x.k = 3 as int)
  from g join o on o.i = g.i + 1, lateral (select list_sort([
    row(pow((g.n1 + o.n) / o.gn, 2) + pow((g.f1 + o.f) / o.gf, 2), g.c1 + 1, 1),
    row(pow((g.n2 + o.n) / o.gn, 2) + pow((g.f2 + o.f) / o.gf, 2), g.c2 + 1, 2),
    row(pow((g.n3 + o.n) / o.gn, 2) + pow((g.f3 + o.f) / o.gf, 2), g.c3 + 1, 3)])[1][3] as k) x)
select family, fold from g where i > 0
""",
    "observations",
)
def _(t: Tables) -> DataFrame:
    rows = t.observations.withColumn("actual", (F.col("outcome") != "pass").cast("int"))
    return balanced_fold_map(rows, 3)


@query(
    "fold_summary",
    """
with f as (select family, cast((dense_rank() over (order by family) - 1) % 4 + 1 as int) as fold from (select distinct family from observations))
select fold, count(distinct o.family) as families, count(*) as rows, cast(sum(case when outcome = 'pass' then 0 else 1 end) as bigint) as failures
from observations o join f on f.family = o.family group by fold
""",
    "observations",
)
def _(t: Tables) -> DataFrame:
    rows = t.observations.withColumn("actual", (F.col("outcome") != "pass").cast("int"))
    return fold_summary(family_folds(rows, 4))


@query(
    "spread_select",
    f"""
with {RANK_SQL}
select package, version, rank from r where n <= 7 or rank in (select cast(round_even(i * (n - 1) / 6.0, 0) as bigint) from (select unnest(generate_series(0, 6)) as i))
""",
    "releases",
)
def _(t: Tables) -> DataFrame:
    return cat.spread_select(t.releases, 7)


@query(
    "select_versions",
    f"""
with {KEY_SQL.replace("k as (", "k0 as (")}, k as (select *, a = 3 and b = 1 and cast(regexp_extract(package, '([0-9]+)$', 1) as int) % 2 = 0 as preserved from k0),
r as (select *, count(*) filter (where preserved) over (partition by package) as np, count(*) filter (where not preserved) over (partition by package) as nr,
  row_number() over (partition by package, preserved order by a, b, c) - 1 as rank from k)
select package, version, preserved from r where np <= 12 and (preserved or (np > 0 and rank >= nr - (12 - np))
  or (np = 0 and (nr <= 12 or rank in (select cast(round_even(i * (nr - 1) / 11.0, 0) as bigint) from (select unnest(generate_series(0, 11)) as i)))))
""",
    "releases",
)
def _(t: Tables) -> DataFrame:
    releases = t.releases.select("package", "version")
    even = F.regexp_extract("package", r"(\d+)$", 1).cast("int") % 2 == 0
    preserved = releases.filter(F.col("version").startswith("3.1.") & even)
    selected, _ = cat.select_versions(releases, preserved, 12)
    return selected


@query(
    "message_limit",
    "select conv_id, turn, rn as message from (select conv_id, turn, row_number() over (partition by conv_id order by turn) as rn from conversations) where rn <= 4",
)
def _(t: Tables) -> DataFrame:
    return conv.message_limit(t.conversations.select("conv_id", "turn"), 5)


@query(
    "evict_oldest",
    """
select conv_id, cast(max(turn) as bigint) as created from conversations group by 1 order by 2 desc, 1 desc limit 50
""",
)
def _(t: Tables) -> DataFrame:
    newest = t.conversations.groupBy("conv_id").agg(F.max("turn").alias("created"))
    return conv.evict_oldest(newest, 50)
