from types import SimpleNamespace

from conftest import rows
from pyspark.sql import functions as F

from pinlattice.operators import observations as obs
from pinlattice.operators.violations import explode_rules
from pinlattice.plans import features as ft
from pinlattice.queries.aggregates import evidence_rows


def log(spark, lines):
    schema = (
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_tax double, "
        "l_returnflag string"
    )
    return evidence_rows(SimpleNamespace(lineitem=spark.createDataFrame(lines, schema)))


LINES = [
    (1, 10, 3, 1, 5.0, 0.01, "A"),
    (2, 10, 3, 1, 4.0, 0.09, "R"),
    (3, 11, 7, 4, 2.0, 0.02, "N"),
    (None, 11, 7, 4, 9.0, 0.02, "A"),
    (4, None, 3, 1, 1.0, 0.01, "A"),
]


def full(results):
    none = F.lit(None).cast("string")
    return results.withColumn(
        "resources",
        F.col("resources")
        .withField("cache_state_before", none)
        .withField("cache_before", F.struct(F.lit(None).cast("long").alias("size_bytes")))
        .withField("machine_before", F.struct(F.lit(4).alias("cpu_count"), F.lit(8).cast("long").alias("memory_total_bytes"))),
    ).withColumn("order", F.col("resources.cache_after.size_bytes"))


def catalog(results):
    pins = F.array("spec.package_a", "spec.package_b")
    wheels = (
        "array<struct<filename:string,python_tag:string,abi_tag:string,platform_tag:string,size:bigint,"
        "has_native_extensions:boolean,yanked:boolean,compatible:boolean>>"
    )
    pinned = results.select(F.explode(pins).alias("p"), F.col("spec.python_version").alias("python_version")).distinct()
    return pinned.select(
        "python_version",
        F.struct(
            "p.name", "p.version", F.lit(">=3.8").alias("requires_python"),
            F.array().cast("array<string>").alias("requires_dist"),
            F.lit("2024-01-01T00:00:00Z").alias("release_date"), F.array().cast(wheels).alias("wheels"),
        ).alias("release"),
    )


def plan(df, which="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), which)()


def joins(node):
    found = [node] if node.nodeName() == "Join" else []
    for i in range(node.children().size()):
        found += joins(node.children().apply(i))
    return found


def test_evidence_rows_travel_once(spark):
    results = full(log(spark, LINES))
    ids = results.select("experiment_id").distinct().select("experiment_id", F.lit("f").alias("family"), F.lit(1).alias("matrix_order"))
    matrix = ids.unionByName(ids.orderBy(F.col("experiment_id").desc_nulls_last()).limit(1))
    order = ["order", "duration_seconds", "outcome"]
    facts = catalog(results)
    first = ft.evidence_feature_row(results, matrix, facts, order)
    apart = ft.evidence_feature_row(obs.first_wins(results, ["experiment_id"], order), matrix, facts)
    assert first.columns == apart.columns
    assert rows(first) == rows(apart)
    assert len(rows(first)) == 5  # one id, and one listed twice: two rows of pins by two of evidence
    # Matrix and two sides of the catalog: the evidence is not joined back.
    assert len(joins(plan(first))) == 3


def test_first_wins_moves_only_what_is_read(spark):
    df = spark.createDataFrame(
        [("a", 2, "x", 1.0), ("a", 1, "y", 2.0), ("a", None, "z", 3.0), (None, 5, "n", 4.0), ("b", 1, "u", 5.0)],
        "k string, o int, wide string, v double",
    )
    kept = obs.first_wins(df, ["k"], ["o"])
    assert kept.columns == df.columns
    assert rows(kept) == sorted([("a", None, "z", 3.0), (None, 5, "n", 4.0), ("b", 1, "u", 5.0)], key=repr)
    text_of_plan = plan(kept.select("k", "v"), "executedPlan").toString()
    assert "Exchange" in text_of_plan and "wide" not in text_of_plan.split("Exchange")[0]
    assert "WindowGroupLimit" in text_of_plan


def test_audit_joins_rule_names_not_rows(spark):
    results = log(spark, LINES)
    matrix = results.filter("spec.package_a.name = 'pkg-10'").select("experiment_id")
    broken = obs.evidence_audit(matrix, results)
    assert rows(broken.filter("rule = 'spec_absent_from_matrix'").groupBy("key").count(), "count") == [(1,), (2,)]
    known = matrix.select(F.col("experiment_id").alias("calculated_id"), F.lit(True).alias("in_matrix")).distinct()
    whole = obs.with_spec_id(results).join(known, "calculated_id", "left")
    assert rows(broken) == rows(explode_rules(whole, F.col("experiment_id"), obs.evidence_rules()))
    (join,) = joins(plan(broken))
    assert join.children().apply(0).output().size() <= 3


def sort_keys(df):
    return [line for line in plan(df, "executedPlan").toString().splitlines() if "Sort [" in line]


def test_join_keys_are_columns_not_expressions(spark):
    """A canonical name as a sort key was worked out at every comparison."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        results = full(log(spark, LINES[:3]))
        s = F.col("spec")
        experiments = results.select(
            "experiment_id", F.lit("f").alias("family"), F.lit(1).alias("matrix_order"), "spec.python_version",
            s["package_a"]["name"].alias("package_a"), s["package_a"]["version"].alias("version_a"),
            s["package_b"]["name"].alias("package_b"), s["package_b"]["version"].alias("version_b"),
        ).withColumn("package_a", F.replace("package_a", F.lit("-"), F.lit("_.")))
        frame = ft.large_features(experiments, catalog(results))
        assert len(sort_keys(frame)) >= 6
        assert not [line for line in sort_keys(frame) if "regexp_replace" in line]
        assert rows(frame, "package_a_name", "package_a_selected_version_rank") == [("pkg_.10", 0)] * 2 + [("pkg_.11", 0)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
