"""Readers, writers, resumable loads and checksums.

The queries write data derived from the given tables to the shared folder in the
source format and read it back with the typed readers.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pinlattice import schemas
from pinlattice.constants import PYTHON_VERSIONS
from pinlattice.functions.text import text_hash_matches
from pinlattice.operators import catalog as cat
from pinlattice.operators.matrix import assign_shards
from pinlattice.operators.violations import union_all
from pinlattice.queries.adapters import Tables
from pinlattice.queries.joins import MATRIX_SQL, SCOPE_SQL, numbered_of, vector_table
from pinlattice.queries.projections import (
    AUDIT_SQL,
    PLAN_SQL,
    PYTHON_ROWS,
    MINOR,
    audited,
    payloads,
    plan_packages,
    projects,
)
from pinlattice.queries.registry import query
from pinlattice.sources import manifests, readers, writers
from pinlattice.sources.documents import write_document
from pinlattice.session import shared_folder


def put_json(t: Tables, df: DataFrame, name: str) -> str:
    path = shared_folder(t.spark, name)
    df.write.json(path)
    return path


def record(*columns: str) -> Column:
    return F.to_json(F.struct(*columns)).alias("value")


@query(
    "read_jsonl",
    """
select python_version, outcome, count(*) as row_count, round(sum(bytes), 2) as bytes, min(experiment_id) as first_id from observations group by all
""",
    "observations",
)
def _(t: Tables) -> DataFrame:
    rows = t.observations.select("experiment_id", "python_version", "outcome", "bytes")
    path = put_json(t, rows, "log")
    schema = "experiment_id string, python_version string, outcome string, bytes double"
    back = readers.read_jsonl(t.spark, path, schema)
    missing = readers.read_jsonl(t.spark, f"{path}-missing", schema)
    return back.unionByName(missing).groupBy("python_version", "outcome").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.round(F.sum("bytes"), 2).alias("bytes"),
        F.min("experiment_id").alias("first_id"),
    )


@query(
    "read_jsonl_tolerant",
    """
select cast(o_orderkey as varchar) as value, case when o_orderkey % 7 = 0 then 'rejected' else 'good' end as kind from orders where o_orderkey % 5 <> 1
""",
)
def _(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    line = (
        F.when(k % 5 == 1, "  ")
        .when(k % 7 == 0, F.concat(F.lit('{"id": '), k.cast("string")))
        .otherwise(F.concat(F.lit('{"id": '), k.cast("string"), F.lit("}")))
    )
    path = shared_folder(t.spark, "lines")
    t.orders.select(line.alias("value")).write.text(path)
    good, bad = readers.read_jsonl_tolerant(t.spark, path, "id bigint")
    return good.select(F.col("id").cast("string").alias("value"), F.lit("good").alias("kind")).unionByName(
        bad.select(F.regexp_extract("line", r"(\d+)", 1).alias("value"), F.lit("rejected").alias("kind"))
    )


@query(
    "append_rows",
    "select event_type, count(*) as row_count, count(distinct event_id) as ids from events group by 1",
)
def _(t: Tables) -> DataFrame:
    path = shared_folder(t.spark, "appended")
    rows = t.events.select("event_id", "event_type")
    writers.append_rows(rows.filter("event_id % 2 = 0"), path)
    writers.append_rows(rows.filter("event_id % 2 = 1"), path)
    return t.spark.read.parquet(path).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("row_count"), F.count_distinct("event_id").alias("ids")
    )


@query("rewrite_table", "select event_id, event_type from events where event_type <> 'error'")
def _(t: Tables) -> DataFrame:
    path = shared_folder(t.spark, "rewritten")
    writers.rewrite_table(t.events.select("event_id", "event_type"), path)
    stored = writers.read_current(t.spark, path)
    writers.rewrite_table(stored.filter("event_type <> 'error'"), path)
    return writers.read_current(t.spark, path)


@query(
    "read_scope",
    f"""
with a as ({AUDIT_SQL}), v as (select package, version, row_number() over (partition by package order by version) - 1 as i from (select distinct package, version from a)),
x as (select a.package, a.version, cast(v.i as int) as version_order, a.python_version, a.eligible, a.reason, a.compatible_wheels, v.i % 5 = 1 as bare, v.i % 5 = 2 as plain
  from a join v on v.package = a.package and v.version = a.version)
select package, version, version_order, python_version, case when bare then null else eligible end as eligible,
  case when bare or plain then case when eligible and plain then 'eligible' else 'not_covered' end else reason end as reason,
  case when bare then null when plain then cast(eligible as int) else compatible_wheels end as compatible_wheels from x
""",
    "releases",
)
def _(t: Tables) -> DataFrame:
    """Every fifth version is a bare string, every fifth has coverage without details."""
    detail = F.struct(
        F.struct(
            F.split("python_version", r"\.")[1].cast("int").alias("o"),
            "eligible",
            F.struct(F.col("python_version").alias("python"), "eligible", "reason", "compatible_wheels").alias("d"),
        ).alias("x")
    )
    versions = audited(t).groupBy("package", "version").agg(
        F.array_sort(F.collect_list(detail["x"])).alias("targets")
    )
    coverage = F.transform("targets", lambda x: x["eligible"])
    details = F.transform("targets", lambda x: x["d"])
    listed = versions.groupBy("package").agg(
        F.array_sort(
            F.collect_list(
                F.struct("version", coverage.alias("coverage"), details.alias("coverage_details"))
            )
        ).alias("versions")
    )
    shown = F.transform(
        "versions",
        lambda v, i: F.when(i % 5 == 1, v["version"])
        .when(i % 5 == 2, F.to_json(F.struct(v["version"].alias("version"), v["coverage"].alias("coverage"))))
        .otherwise(F.to_json(v)),
    )
    packages = listed.select(F.col("package").alias("name"), shown.alias("versions")).select(
        "name", F.lit("library").alias("role"), F.lit("development").alias("split"), "versions"
    )
    path = write_document(
        t.spark,
        shared_folder(t.spark, "scope"),
        {"packages": (packages.select("name", record("role", "split", "versions")), ["name"])},
        {"coverage_order": json.dumps(PYTHON_VERSIONS)},
    )
    return readers.read_scope(t.spark, path).drop("role", "split")


def family_records(t: Tables) -> DataFrame:
    return t.families.select(F.col("family").alias("name"), "package_a", "package_b", "split").select(
        record("name", "package_a", "package_b", "split")
    )


@query(
    "read_pairs",
    "select family, package_a, package_b, split, '3.10,3.11' as python_versions from families",
    "families",
)
def _(t: Tables) -> DataFrame:
    path = write_document(
        t.spark,
        shared_folder(t.spark, "pairs"),
        {"families": (family_records(t), ["value"])},
        {"python_versions": '["3.10", "3.11"]'},
    )
    rows = readers.read_pairs(t.spark, path)
    return rows.withColumn("python_versions", F.array_join("python_versions", ","))


@query(
    "read_plan",
    f"""
with {PLAN_SQL}
select 'package' as kind, package as name, role as a, split as b, cast(minimum_versions as varchar) as c from p
union all select 'family', family, package_a, package_b, split from families
""",
    "releases families",
)
def _(t: Tables) -> DataFrame:
    packages = plan_packages(t).select(
        F.col("package").alias("name"),
        "role",
        "split",
        F.when(F.col("minimum_versions") == 1, 1).alias("minimum_versions"),
    )
    path = write_document(
        t.spark,
        shared_folder(t.spark, "plan"),
        {
            "packages": (packages.select("name", record("role", "split", "minimum_versions")), ["name"]),
            "families": (family_records(t), ["value"]),
        },
        {"target_versions_per_package": "12", "minimum_versions_per_package": "3"},
    )
    p, f = readers.read_plan(t.spark, path)
    return p.select(
        F.lit("package").alias("kind"),
        F.col("package").alias("name"),
        F.col("role").alias("a"),
        F.col("split").alias("b"),
        F.col("minimum_versions").cast("string").alias("c"),
    ).unionByName(
        f.select(
            F.lit("family").alias("kind"),
            F.col("family").alias("name"),
            F.col("package_a").alias("a"),
            F.col("package_b").alias("b"),
            F.col("split").alias("c"),
        )
    )


@query(
    "read_manifest",
    """
with v as (select distinct package, version from releases),
m as (select family, package_a, package_b, version from families join v on v.package = package_a),
o as (select *, row_number() over (order by family, version) - 1 as position from m)
select cast(position as int) as position, family, concat(package_a, '==', version) as package_a, concat(package_b, '==1.0') as package_b, '3.10' as python, 'linux_x86_64' as platform,
  substr(sha256(concat_ws('|', package_a, version, package_b, '1.0', '3.10', 'linux', 'x86_64')), 1, 20) as experiment_id
from o
""",
    "releases families",
)
def _(t: Tables) -> DataFrame:
    versions = t.releases.select(F.col("package").alias("package_a"), "version").distinct()
    rows = t.families.join(versions, "package_a")
    experiments = rows.select(
        "family",
        "version",
        F.concat("package_a", F.lit("=="), "version").alias("package_a"),
        F.concat("package_b", F.lit("==1.0")).alias("package_b"),
        F.lit("3.10").alias("python"),
    ).select("family", "version", record("family", "package_a", "package_b", "python"))
    path = write_document(
        t.spark, shared_folder(t.spark, "manifest"), {"experiments": (experiments, ["family", "version"])}
    )
    return readers.read_manifest(t.spark, path)


@query(
    "read_shard_dir",
    f"""
with {SCOPE_SQL}, {MATRIX_SQL},
o as (select experiment_id, row_number() over (order by family, cast(substr(python_version, 3) as int), version_a, version_b, experiment_id) as rn from m where eligible)
select experiment_id, cast(floor((rn - 1) / 2000) + 1 as int) as shard_index, cast((rn - 1) % 2000 as int) as position from o
""",
    "releases families",
)
def _(t: Tables) -> DataFrame:
    """Shard files of 2000 experiments each (a shard is bounded by its size)."""
    ordered = assign_shards(numbered_of(t), 2000)
    item = F.struct(
        "matrix_order",
        F.struct(
            "family",
            F.concat("package_a", F.lit("=="), "version_a").alias("package_a"),
            F.concat("package_b", F.lit("=="), "version_b").alias("package_b"),
            F.col("python_version").alias("python"),
        ).alias("e"),
    )
    shards = ordered.groupBy("shard_index", "shard_count").agg(
        F.transform(F.array_sort(F.collect_list(item)), lambda x: x["e"]).alias("experiments")
    )
    path = shared_folder(t.spark, "shards")
    value = F.to_json(F.struct("shard_index", "shard_count", "experiments"))
    shards.select(value.alias("value"), F.col("shard_index").alias("shard")).repartition(
        "shard"
    ).write.partitionBy("shard").text(path)
    rows = readers.read_shard_dir(t.spark, f"{path}/*/*.txt")
    return rows.select("experiment_id", "shard_index", "position")


@query(
    "read_features_csv",
    """
select python_version, count(*) as row_count, round(sum(duration_seconds), 2) as seconds, min(experiment_id) as first_id from observations group by 1
""",
    "observations",
)
def _(t: Tables) -> DataFrame:
    path = shared_folder(t.spark, "features-csv")
    rows = t.observations.select("experiment_id", "python_version", "duration_seconds")
    writers.write_features(rows, path, "csv")
    back = readers.read_features_csv(
        t.spark, path, ["python_version", "duration_seconds"], ["experiment_id", "python_version"]
    )
    return back.groupBy("python_version").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.round(F.sum("duration_seconds"), 2).alias("seconds"),
        F.min("experiment_id").alias("first_id"),
    )


@query(
    "write_features",
    "select family, outcome, count(*) as row_count, sum(duration_seconds) as seconds from observations group by all",
    "observations",
)
def _(t: Tables) -> DataFrame:
    path = shared_folder(t.spark, "features")
    writers.write_features(t.observations.select("family", "outcome", "duration_seconds"), path)
    return t.spark.read.parquet(path).groupBy("family", "outcome").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("duration_seconds").alias("seconds")
    )


@query(
    "normalize_release",
    f"""
with g as (select package, version, max(requires_python) as rp from releases group by 1, 2),
w as (select r.*, g.rp, p.python_version, {MINOR} as m from releases r join g on r.package = g.package and r.version = g.version cross join {PYTHON_ROWS} p),
a as (select *, rp is null or (rp = '>=3.9' and m >= 9) or (rp = '>=3.9,<3.12' and m between 9 and 11) as allowed,
  filename like '%py3-none-any.whl' or filename like '%cp38-abi3-manylinux%' or (filename like '%cp311-cp311-manylinux%' and m = 11) as fits from w)
select package, version, python_version, release_id, filename, yanked, allowed and fits and not yanked as compatible,
  not filename like '%none-any.whl' as native, not allowed as excluded_by_python from a
""",
    "releases",
)
def _(t: Tables) -> DataFrame:
    path = put_json(t, payloads(t), "payloads")
    raw = readers.read_jsonl(t.spark, path, schemas.RAW_RELEASE)
    from pinlattice.constants import PYTHON_VERSIONS

    rows = cat.normalize_release(raw, PYTHON_VERSIONS)
    return rows.select(
        F.col("release.name").alias("package"),
        F.col("release.version").alias("version"),
        "python_version",
        F.explode("release.wheels").alias("w"),
    ).select(
        "package",
        "version",
        "python_version",
        F.col("w.size").alias("release_id"),
        "w.filename",
        "w.yanked",
        "w.compatible",
        F.col("w.has_native_extensions").alias("native"),
        F.contains("w.compatibility_reason", F.lit("Requires-Python")).alias("excluded_by_python"),
    )


@query(
    "explode_project_files",
    "select package, version, release_id, filename, concat(cast(released as varchar), 'T00:00:00Z') as uploaded from releases",
    "releases",
)
def _(t: Tables) -> DataFrame:
    raw = readers.read_jsonl(
        t.spark, put_json(t, projects(t), "projects"), schemas.RAW_PROJECT
    )
    return cat.explode_project_files(raw).select(
        "package",
        "version",
        F.col("file.size").alias("release_id"),
        "file.filename",
        F.col("file.upload_time_iso_8601").alias("uploaded"),
    )


@query(
    "read_ranking",
    """
select c_name as project, cast(floor(c_acctbal) as bigint) as download_count from customer where floor(c_acctbal) >= 0 and c_custkey % 9 <> 0
""",
)
def _(t: Tables) -> DataFrame:
    """Ranking payloads of at most 100 rows each, some without a name or with a bad count."""
    row = F.struct(
        F.when(F.col("c_custkey") % 9 != 0, F.col("c_name")).alias("project"),
        F.floor("c_acctbal").alias("download_count"),
    )
    pages = t.customer.groupBy(F.floor(F.col("c_custkey") / 100).alias("page")).agg(
        F.collect_list(row).alias("rows")
    )
    raw = readers.read_jsonl(t.spark, put_json(t, pages, "ranking"), schemas.RAW_RANKING)
    return cat.read_ranking_rows(raw).select("project", "download_count")


@query(
    "load_embeddings",
    """
select concat('label-', cast(label as varchar)) as package, cast(vec_id as varchar) as version, len(embedding) as width,
  round(list_sum(list_transform(embedding, lambda x: cast(x as double))), 6) as total from embeddings
""",
)
def _(t: Tables) -> DataFrame:
    rows = vector_table(t).withColumn("dimensions", F.size("embedding"))
    loaded = readers.load_embeddings(t.spark, put_json(t, rows, "embeddings"))
    return loaded.select(
        "package",
        "version",
        F.size("embedding").cast("bigint").alias("width"),
        F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 6).alias("total"),
    )


@query(
    "resume_write",
    "select url, count(*) as stored, max(sha256(html)) as sha256, true as intact from pages group by url",
)
def _(t: Tables) -> DataFrame:
    """Three runs: a part, everything, everything again. Nothing is stored twice."""
    path = shared_folder(t.spark, "evidence")
    pages = t.pages.select("url", "html")

    def compute(missing: DataFrame) -> DataFrame:
        return missing.withColumn("sha256", F.sha2("html", 256))

    writers.resume_write(pages.filter(F.col("url").startswith("https")), path, ["url"], compute)
    writers.resume_write(pages, path, ["url"], compute)
    stored = writers.resume_write(pages, path, ["url"], compute)
    return stored.groupBy("url").agg(
        F.count(F.lit(1)).alias("stored"),
        F.max("sha256").alias("sha256"),
        F.min(text_hash_matches(F.col("html"), F.col("sha256"))).alias("intact"),
    )


CHUNK_SQL = "c as (select page_id % 16 as chunk, concat(string_agg(html, chr(10) order by page_id), chr(10)) as body from pages group by 1)"


def page_files(t: Tables) -> DataFrame:
    """Checksums of 16 text files with all pages, sorted inside each file."""
    path = shared_folder(t.spark, "files")
    rows = t.pages.select("html", "page_id", (F.col("page_id") % 16).alias("chunk"))
    (
        rows.repartition("chunk")
        .sortWithinPartitions("chunk", "page_id")
        .select(F.col("html").alias("value"), "chunk")
        .write.partitionBy("chunk")
        .text(path)
    )
    return manifests.file_checksums(t.spark, path, "*.txt")


@query(
    "file_checksums",
    f"with {CHUNK_SQL} select octet_length(encode(body)) as bytes, sha256(body) as sha256 from c",
)
def _(t: Tables) -> DataFrame:
    return page_files(t).select("bytes", "sha256")


@query(
    "fileset_digest",
    f"""
with {CHUNK_SQL}, n as (select sha256(body) as f, octet_length(encode(body)) as bytes from c),
l as (select substr(sha256(f), 1, 4) as leaf, count(*) as files, sum(bytes) as bytes, sha256(string_agg(f || '  ' || f, chr(10) order by f)) as d from n group by 1),
b as (select substr(leaf, 1, 2) as branch, sum(files) as files, sum(bytes) as bytes, sha256(string_agg(leaf || ' ' || d, chr(10) order by leaf)) as d from l group by 1)
select cast(sum(files) as bigint) as files, cast(sum(bytes) as bigint) as bytes, sha256(string_agg(branch || ' ' || d, chr(10) order by branch)) as digest from b
""",
)
def _(t: Tables) -> DataFrame:
    """Written files have names of their own, so each goes by its content here."""
    return manifests.fileset_digest(page_files(t).withColumn("file", F.col("sha256")))


@query(
    "verify_frozen",
    f"""
with {CHUNK_SQL} select 'changed_file' as rule, sha256(body) as sha256 from c where substr(sha256(body), 1, 1) < '8'
union all select 'missing_file', ''
""",
)
def _(t: Tables) -> DataFrame:
    actual = page_files(t)
    frozen = actual.select(
        "file",
        F.when(F.substring("sha256", 1, 1) < "8", F.reverse("sha256"))
        .otherwise(F.upper("sha256"))
        .alias("sha256"),
    )
    gone = actual.agg(F.lit("gone.txt").alias("file"), F.lit("00").alias("sha256"))
    problems = manifests.verify_frozen(union_all([frozen, gone]), actual)
    hashes = actual.select(F.col("file").alias("key"), "sha256")
    return problems.join(hashes, "key", "left").select(
        "rule", F.coalesce("sha256", F.lit("")).alias("sha256")
    )


@query(
    "dataset_manifest",
    """
select count(*) as rows, count(distinct experiment_id) as distinct_ids, count(*) filter (where outcome = 'pass') as passed,
  count(*) filter (where outcome <> 'pass') as failed, count(distinct family) as families from observations
""",
    "observations",
)
def _(t: Tables) -> DataFrame:
    return manifests.dataset_manifest(t.observations)
