"""Training, scoring and evaluation over rows derived from the order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinlattice.functions.vectors import norm, pair_interactions
from pinlattice.operators import boosting as bst
from pinlattice.operators import models as md
from pinlattice.operators import network as nw
from pinlattice.operators import preprocess as pre
from pinlattice.operators import scoring as sc
from pinlattice.operators import texts as tx
from pinlattice.operators.folds import balanced_folds
from pinlattice.operators.metrics import binary_metrics, roc_auc
from pinlattice.operators.violations import violation
from pinlattice.plans.training import evaluate_blind, fit_final
from pinlattice.queries.adapters import Tables
from pinlattice.queries.aggregates import (
    COUNTS_SQL,
    OUT_SQL,
    RATE_NAMES,
    RATES_SQL,
    SCORED_SQL,
    rounded,
    scored,
)
from pinlattice.queries.joins import vector_pairs, vector_table
from pinlattice.queries.registry import query

NUMERIC = ["quantity", "price", "discount", "tax"]
CATEGORICAL = ["python_version", "line_status"]


def training(t: Tables) -> DataFrame:
    """One evaluable experiment per order line."""
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    return t.lineitem.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("experiment_id"),
        F.concat(F.lit("family-"), (F.col("l_suppkey") % 6).cast("string")).alias("family"),
        F.when(F.col("l_linenumber") != 2, F.col("l_quantity")).alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.concat(F.lit("3."), (8 + F.col("l_partkey") % 7).cast("string")).alias("python_version"),
        status.alias("line_status"),
        F.when(flag == "R", "resolution_failure")
        .when((flag == "N") & (status == "O") & (F.col("l_quantity") > 20), "import_failure")
        .when((flag == "N") & (F.col("l_extendedprice") < 40000), "smoke_test_failure")
        .otherwise("pass")
        .alias("outcome"),
    ).withColumn("actual", (F.col("outcome") != "pass").cast("int"))


def feature_rows(t: Tables) -> tuple[DataFrame, pre.Preprocessor]:
    rows = training(t)
    preprocessor = pre.fit_preprocessor(rows, NUMERIC, CATEGORICAL)
    return preprocessor.transform(rows), preprocessor


@query(
    "transform_features",
    """
with x as (select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as experiment_id, case when l_linenumber = 2 then null else l_quantity end as quantity,
  l_extendedprice as price, l_partkey % 7 as p, l_linestatus as s from lineitem),
m as (select quantile_cont(quantity, 0.5) as mq, quantile_cont(price, 0.5) as mp from x),
f as (select experiment_id, coalesce(quantity, mq) as q, price, p, s from x, m),
g as (select avg(q) as aq, stddev_pop(q) as sq, avg(price) as ap, stddev_pop(price) as sp from f)
select experiment_id, round((q - aq) / sq, 5) as quantity, round((price - ap) / sp, 5) as price, 13 as width, cast(p = 2 as double) as is_310, cast(s = 'O' as double) as is_o
from f, g
""",
)
def _(t: Tables) -> DataFrame:
    rows, preprocessor = feature_rows(t)
    at = {name: i for i, name in enumerate(preprocessor.names)}

    def value(name: str):
        return F.get("features", F.lit(at[name]))

    return rows.select(
        "experiment_id",
        F.round(value("numeric::quantity"), 5).alias("quantity"),
        F.round(value("numeric::price"), 5).alias("price"),
        F.size("features").alias("width"),
        value("category::python_version==3.10").alias("is_310"),
        value("category::line_status==O").alias("is_o"),
    )


def _quality(scored_rows: DataFrame) -> DataFrame:
    """Metrics of a scored table: what a fitted model is judged by."""
    predicted = scored_rows.withColumn("predicted", (F.col("probability") >= 0.5).cast("int"))
    area = roc_auc(predicted, "probability")
    return binary_metrics(predicted).join(F.broadcast(area))


ACTUAL_SQL = """a as (select case when l_returnflag = 'R' or (l_returnflag = 'N' and l_linestatus = 'O' and l_quantity > 20)
  or (l_returnflag = 'N' and l_extendedprice < 40000) then 1 else 0 end as actual, concat('family-', cast(l_suppkey % 6 as varchar)) as family from lineitem)"""


def _balance(rows: DataFrame, weight=None) -> DataFrame:
    """At the optimum the slope along the free intercept is 0: mean probability and mean label agree, weighted alike."""
    w = F.lit(1.0) if weight is None else weight
    return rows.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum(F.col("actual").cast("bigint")).alias("failures"),
        F.round(F.sum(w * F.col("probability")) / F.sum(w), 4).alias("mean_probability"),
        F.round(F.sum(w * (F.col("probability") - F.col("actual"))) / F.count(F.lit(1)), 5).alias("slope"),
    )


@query(
    "fit_logistic",
    f"with {ACTUAL_SQL} select count(*) as row_count, cast(sum(actual) as bigint) as failures, round(avg(actual), 4) as mean_probability, cast(0 as double) as slope from a",
)
def _(t: Tables) -> DataFrame:
    rows, _ = feature_rows(t)
    model = md.fit_logistic(rows, label="actual")
    return _balance(rows.withColumn("probability", model.probability(F.col("features"))))


@query(
    "fit_weighted_logistic",
    f"with {ACTUAL_SQL} select count(*) as row_count, cast(sum(actual) as bigint) as failures, cast(0.5 as double) as mean_probability, cast(0 as double) as slope from a",
)
def _(t: Tables) -> DataFrame:
    """Balanced classes weigh alike, so the weighted mean probability is a half."""
    rows, _ = feature_rows(t)
    model = md.fit_weighted_logistic(rows, label="actual")
    scored_rows = rows.withColumn("probability", model.probability(F.col("features")))
    weights = pre.balanced_weights(rows, "actual").select(F.col("actual").alias("__label"), "weight")
    # Two rows of weights.
    weighted = scored_rows.join(F.broadcast(weights), F.col("actual") == F.col("__label"))
    return _balance(weighted, F.col("weight"))


@query(
    "bin_features",
    """
select l_orderkey, l_linenumber, l_partkey, concat(cast(cast(l_quantity >= 10 as int) + cast(l_quantity >= 25 as int) + cast(l_quantity >= 40 as int) as varchar), ',',
  cast(cast(l_discount >= 0.05 as int) as varchar), ',0') as bins from lineitem
""",
)
def _(t: Tables) -> DataFrame:
    bins = pre.bin_values(
        F.array("l_quantity", "l_discount", "l_tax"), [[10.0, 25.0, 40.0], [0.05], []]
    )
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.array_join(bins.cast("array<string>"), ",").alias("bins"),
    )


def binned(t: Tables) -> tuple[DataFrame, int, list[list[float]]]:
    rows, preprocessor = feature_rows(t)
    cuts = pre.fit_bins(rows, "features")
    bins = pre.bin_values(F.col("features"), cuts)
    return rows.withColumn("bins", bins), preprocessor.width, cuts


@query("fit_boosting")
def _(t: Tables) -> DataFrame:
    rows, width, cuts = binned(t)
    head = bst.fit_boosting(rows, width, label="actual")
    return _quality(bst.score_heads(rows, {"failure": head}, cuts))


@query("fit_two_head")
def _(t: Tables) -> DataFrame:
    rows, width, cuts = binned(t)
    heads = bst.fit_heads(rows, width, bst.TWO_HEAD)
    return _quality(bst.score_heads(rows, heads, cuts))


@query("fit_stage_aware")
def _(t: Tables) -> DataFrame:
    rows, width, cuts = binned(t)
    heads = bst.fit_heads(rows, width, bst.STAGE_AWARE)
    return _quality(bst.score_heads(rows, heads, cuts))


@query("fit_multiclass")
def _(t: Tables) -> DataFrame:
    from pinlattice.operators.metrics import multiclass_metrics
    from pinlattice.queries.aggregates import CLASSES

    rows, preprocessor = feature_rows(t)
    model = nw.fit_network(rows, CLASSES, preprocessor.width)
    return multiclass_metrics(nw.score_network(rows, model), CLASSES)


@query("fit_projection")
def _(t: Tables) -> DataFrame:
    vectors = vector_table(t)
    projection = md.fit_projection(vectors, vectors, 32)
    return vectors.select(
        "package", "version", F.posexplode(projection.project(F.col("embedding"))).alias("axis", "value")
    )


@query(
    "pair_interactions",
    """
with p as (select a.vec_id, list_transform(list_zip(a.embedding, b.embedding), lambda z: [cast(z[1] as double), cast(z[2] as double)]) as z
  from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)
select vec_id, 256 as width, round(list_sum(list_transform(z, lambda x: x[1] + x[2] + abs(x[1] - x[2]) + x[1] * x[2])), 6) as total from p
""",
)
def _(t: Tables) -> DataFrame:
    a = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").cast("array<double>").alias("b"))
    x = pair_interactions(F.col("a"), F.col("b"))
    return a.join(b, "vec_id").select(
        "vec_id",
        F.size(x).alias("width"),
        F.round(F.aggregate(x, F.lit(0.0), lambda s, v: s + v), 6).alias("total"),
    )


def text_pairs(t: Tables) -> DataFrame:
    """Pairs of vectors with a few structured columns."""
    return vector_pairs(t).withColumn("size_a", F.length("package_a_version").cast("double")).withColumn(
        "kind", F.col("package_a_name")
    )


@query(
    "hybrid_matrix",
    """
select cast(a.vec_id as varchar) as experiment_id, 1 + (select count(distinct label) from embeddings) + 128 as width, true as finite
from embeddings a join embeddings b on b.vec_id = a.vec_id + 1 and b.label = (a.label + 1) % 10
""",
)
def _(t: Tables) -> DataFrame:
    vectors = vector_table(t).withColumn(
        "package", F.lower(F.replace("package", F.lit("."), F.lit("-")))
    )
    pairs = text_pairs(t)
    known = md.join_embeddings(pairs, vectors).drop("vector_a", "vector_b")
    preprocessor = pre.fit_preprocessor(pairs, ["size_a"], ["kind"])
    features = md.fit_hybrid_features(known, vectors, preprocessor, 32)
    rows = features.transform(known, vectors)
    return rows.select(
        "experiment_id",
        F.size("features").cast("bigint").alias("width"),
        F.forall("features", lambda x: ~F.isnan(x)).alias("finite"),
    )


@query("out_of_fold")
def _(t: Tables) -> DataFrame:
    folded = balanced_folds(training(t), 5)
    scored_rows, problems = md.held_out_scores(folded, NUMERIC, CATEGORICAL)
    uncovered = problems.agg(F.count(F.lit(1)).alias("uncovered"))
    return _quality(scored_rows).join(F.broadcast(uncovered))


@query(
    "leave_one_family_out",
    f"""
with {ACTUAL_SQL}, f as (select family, count(*) as n, cast(sum(actual) as bigint) as p from a group by 1),
m as (select *, ((select sum(p) from f) - p) * 2 >= (select sum(n) from f) - n as fails from f)
select family, n as row_count, p as failures, fails as train_majority_fails, round(case when fails then p / n else 1 - p / n end, 6) as majority_accuracy, cast(0 as bigint) as uncovered from m
""",
)
def _(t: Tables) -> DataFrame:
    """Rows and failures come back through the predictions: a row without one would be missing."""
    metrics, problems = md.leave_one_family_out(training(t), NUMERIC, CATEGORICAL)
    hits, misses = F.col("true_positive"), F.col("false_negative")
    return metrics.select(
        "family",
        (hits + misses + F.col("true_negative") + F.col("false_positive")).cast("bigint").alias("row_count"),
        (hits + misses).cast("bigint").alias("failures"),
        "train_majority_fails",
        F.round("majority_accuracy", 6).alias("majority_accuracy"),
    ).join(F.broadcast(problems.agg(F.count(F.lit(1)).alias("uncovered"))))


def _candidate_sql(threshold_first: str, threshold_second: str) -> str:
    return f"""
x as (select 'first' as candidate, 0 as listed, outcome, actual, score as q, {threshold_first} as t from s union all select 'second', 1, outcome, actual, other, {threshold_second} from s),
p as (select *, case when q >= t then 1 else 0 end as predicted from x),
c as (select candidate, listed, {COUNTS_SQL}, avg((q - actual) * (q - actual)) as brier from p group by 1, 2),
r as (select *, {RATES_SQL} from c)
"""


BEST_SQL = """
t as (select 'first' as candidate, score as t from s union select 'second', other from s union select unnest(['first', 'first', 'first', 'second', 'second', 'second']), unnest([0.0, 0.5, 1.0, 0.0, 0.5, 1.0])),
g as (select 'first' as candidate, score as q, count(*) as n, cast(sum(actual) as bigint) as p from s group by 2 union all select 'second', other, count(*), cast(sum(actual) as bigint) from s group by 2),
u as (select t.candidate, t.t, coalesce(sum(n) filter (where q < t), 0) as bn, coalesce(sum(p) filter (where q < t), 0) as bp, sum(n) as an, sum(p) as ap from t join g on g.candidate = t.candidate group by 1, 2),
k as (select *, row_number() over (partition by candidate order by ((ap - bp) / cast(ap as double) + (bn - bp) / cast(an - ap as double)) / 2 desc, (ap - bp) / cast(ap as double) desc, abs(t - 0.5), t) as rn from u)
"""


@query(
    "evaluate_candidates",
    f"""
with {SCORED_SQL}, {BEST_SQL}, {_candidate_sql("(select t from k where rn = 1 and candidate = 'first')", "(select t from k where rn = 1 and candidate = 'second')")}
select candidate, round((recall + specificity) / 2, 6) as balanced_accuracy, round(recall, 6) as recall, round(brier, 6) as brier_score,
  (select max(t) from k where rn = 1 and k.candidate = r.candidate) as threshold from r
""",
    "observations",
)
def _(t: Tables) -> DataFrame:
    table = md.evaluate_candidates(scored(t), {"first": "score", "second": "other"})
    return rounded(table, ("balanced_accuracy", "recall", "brier_score")).select(
        "candidate", "balanced_accuracy", "recall", "brier_score", "threshold"
    )


@query("fit_final_and_blind")
def _(t: Tables) -> DataFrame:
    rows = training(t)
    train = rows.filter("family <> 'family-5'")
    blind = rows.filter("family = 'family-5'").drop("outcome", "actual")
    frozen, _, _ = fit_final(train, NUMERIC, CATEGORICAL, folds=5)
    return frozen.predict(blind).select("experiment_id", "probability", "predicted")


@query(
    "evaluate_blind",
    f"""
with {SCORED_SQL.replace("s as (", "s0 as (")}, u as (select experiment_id from s0 group by 1 having count(*) = 1),
s as (select * from s0 where experiment_id in (select experiment_id from u) and outcome <> 'infrastructure_failure'), {_candidate_sql("0.4", "0.3")}
select candidate, {OUT_SQL} from r
""",
    "observations",
)
def _(t: Tables) -> DataFrame:
    rows = scored(t).filter("outcome <> 'infrastructure_failure'")
    unique = scored(t).groupBy("experiment_id").agg(F.count(F.lit(1)).alias("n")).filter("n = 1")
    rows = rows.join(unique.select("experiment_id"), "experiment_id")
    stored = rows.select("experiment_id", "score", "other")
    none = violation(rows.filter("false"), "none", F.col("experiment_id"))
    metrics, _, _ = evaluate_blind(
        stored,
        stored,
        rows.select("experiment_id", "outcome"),
        {"first": ("score", 0.4), "second": ("other", 0.3)},
        none,
    )
    names = ("true_positive", "false_positive", "true_negative", "false_negative", *RATE_NAMES)
    return rounded(metrics).select("candidate", *names)


@query(
    "compare_models",
    f"""
with {SCORED_SQL}, {_candidate_sql("0.5", "0.5")},
b as (select candidate, (recall + specificity) / 2 as v, recall as w from r)
select candidate, round(v, 6) as balanced_accuracy, round(w, 6) as recall, round(v - (select v from b where candidate = 'first'), 6) as balanced_accuracy_change,
  round(w - (select w from b where candidate = 'first'), 6) as recall_change from b
""",
    "observations",
)
def _(t: Tables) -> DataFrame:
    rows = md.stack_candidates(
        scored(t), {"first": "score", "second": "other"}, ["outcome", "actual"]
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    table = md.compare_models(
        binary_metrics(rows, by=["candidate"]), "first", ["balanced_accuracy", "recall"]
    )
    return rounded(table, [c for c in table.columns if c != "candidate"])


@query(
    "combine_scores",
    """
with l as (select doc_id, score from labelled)
select doc_id, round(1 - (1 - score) * (1 - score * 0.5), 9) as hybrid_probability from l
""",
    "labelled",
)
def _(t: Tables) -> DataFrame:
    left = t.labelled.select("doc_id", F.col("score").alias("probability"))
    right = left.withColumn("probability", F.col("probability") * 0.5)
    combined = md.combine_scores(left, right, "doc_id")
    return combined.select("doc_id", F.round("hybrid_probability", 9).alias("hybrid_probability"))


@query(
    "prediction_drift",
    """
select 'prediction_differs_probability' as rule, cast(doc_id as varchar) as key from labelled where doc_id % 6 = 0
""",
    "labelled",
)
def _(t: Tables) -> DataFrame:
    stored = t.labelled.select("doc_id", F.col("score").alias("probability"))
    again = stored.withColumn(
        "probability",
        F.when(F.col("doc_id") % 6 == 0, F.col("probability") + 1e-6).otherwise(F.col("probability")),
    )
    return md.prediction_drift(stored, again, ["probability"], "doc_id").select("rule", "key")


@query(
    "score_linear",
    """
with x as (select l_orderkey, l_linenumber, l_partkey, 0.3 + l_quantity * 0.05 - l_discount * 12 - l_tax * 3 as z from lineitem),
p as (select *, 1 / (1 + exp(-greatest(least(z, 35.0), -35.0))) as p from x)
select l_orderkey, l_linenumber, l_partkey, round(p, 9) as probability, p >= 0.62 as predicted_failure from p
""",
)
def _(t: Tables) -> DataFrame:
    model = md.LinearModel((0.05, -12.0, -3.0), 0.3, 0.62)
    rows = t.lineitem.withColumn("features", F.array("l_quantity", "l_discount", "l_tax"))
    return sc.score_linear(rows, model).select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.round("structured_probability", 9).alias("probability"),
        "predicted_failure",
    )


TREES = {
    "base_logit": -0.4,
    "learning_rate": 0.5,
    "trees": [
        {
            "nodes": [
                {"value": 0.0, "feature": 0, "split_bin": 1, "left": 1, "right": 2},
                {"value": -1.5, "feature": -1, "split_bin": -1, "left": -1, "right": -1},
                {"value": 0.0, "feature": 1, "split_bin": 0, "left": 3, "right": 4},
                {"value": 0.75, "feature": -1, "split_bin": -1, "left": -1, "right": -1},
                {"value": 2.0, "feature": -1, "split_bin": -1, "left": -1, "right": -1},
            ]
        },
        {"nodes": [{"value": 0.25, "feature": -1, "split_bin": -1, "left": -1, "right": -1}]},
    ],
}


@query(
    "score_trees",
    """
with x as (select l_orderkey, l_linenumber, l_partkey, -0.4 + 0.5 * (case when l_quantity < 25 then -1.5 when l_discount < 0.05 then 0.75 else 2.0 end) + 0.5 * 0.25 as z from lineitem)
select l_orderkey, l_linenumber, l_partkey, round(1 / (1 + exp(-cast(z as double))), 9) as probability from x
""",
)
def _(t: Tables) -> DataFrame:
    head = bst.BoostedHead.from_payload(TREES)
    rows = t.lineitem.withColumn("features", F.array("l_quantity", "l_discount"))
    scored_rows = bst.score_heads(rows, {"head": head}, [[10.0, 25.0], [0.05]])
    return scored_rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round("probability", 9).alias("probability")
    )


@query(
    "score_post_install",
    """
with a as (select vec_id, label from embeddings),
p as (select cast(vec_id as varchar) as experiment_id, exists (select 1 from embeddings b where b.vec_id = a.vec_id + 1 and b.label = (a.label + 1) % 10) as covered from a)
select experiment_id, covered from p
""",
)
def _(t: Tables) -> DataFrame:
    vectors = vector_table(t).withColumn(
        "package", F.lower(F.replace("package", F.lit("."), F.lit("-")))
    )
    pairs = text_pairs(t)
    known = md.join_embeddings(pairs, vectors).drop("vector_a", "vector_b")
    preprocessor = pre.fit_preprocessor(pairs, ["size_a"], [])
    features = md.fit_hybrid_features(known, vectors, preprocessor, 4)
    cuts = pre.fit_bins(features.transform(known, vectors), "features", 8)
    head = bst.BoostedHead.from_payload(TREES)
    rows = sc.score_post_install(pairs, vectors, features, cuts, head, head)
    return rows.select(
        "experiment_id", F.col("combined_probability").isNotNull().alias("covered")
    )


DECISION_SQL = """
d as (select experiment_id, part_key, supp_key, bytes, case when part_key % 9 = 0 then null else cast(part_key % 50 as double) / 100 end as i, case when part_key % 9 = 0 then null else cast(supp_key % 50 as double) / 100 end as s,
  part_key % 5 <> 0 as allow, cast(supp_key % 7 as double) / 7 as structured from observations),
c as (select *, 1 - (1 - i) * (1 - s) as combined, 1 - (1 - i) * (1 - s) >= 0.4726886805608258 as risk from d)
"""


def decided(t: Tables) -> DataFrame:
    p, s = F.col("part_key"), F.col("supp_key")
    rows = t.observations.select(
        "experiment_id",
        "part_key",
        "bytes",
        F.when(p % 9 != 0, (p % 50).cast("double") / 100).alias("import_probability"),
        F.when(p % 9 != 0, (s % 50).cast("double") / 100).alias("smoke_probability"),
        (p % 5 != 0).alias("constraints_allow"),
        ((s % 7).cast("double") / 7).alias("structured_probability"),
    )
    return sc.post_install_decision(rows)


@query(
    "post_install_decision",
    f"""
with {DECISION_SQL}
select experiment_id, part_key, bytes, round(combined, 9) as combined_probability, risk as risk_detected, risk and i >= s as predicted_import_failure, risk and s > i as predicted_smoke_failure,
  case when i >= s then 'import' when s > i then 'smoke test' end as likely_stage from c
""",
    "observations",
)
def _(t: Tables) -> DataFrame:
    return decided(t).select(
        "experiment_id",
        "part_key",
        "bytes",
        F.round("combined_probability", 9).alias("combined_probability"),
        "risk_detected",
        "predicted_import_failure",
        "predicted_smoke_failure",
        "likely_stage",
    )


@query(
    "score_hybrid",
    f"""
with {SCORED_SQL}
select experiment_id, part_key, bytes, round(greatest(score, other), 9) as risk_score, score >= 0.8 or other >= 0.6 as predicted_failure,
  case when other >= score then 'post-install/import' else 'dependency resolution' end as likely_stage from s
""",
    "observations",
)
def _(t: Tables) -> DataFrame:
    rows = sc.score_hybrid(scored(t), "score", "score", "other", 0.8, 0.6)
    return rows.select(
        "experiment_id",
        "part_key",
        "bytes",
        F.round("risk_score", 9).alias("risk_score"),
        "predicted_failure",
        "likely_stage",
    )


@query(
    "pair_risk",
    f"""
with {DECISION_SQL}
select experiment_id, part_key, bytes, case when not allow then 'published_constraint_conflict' when combined is null then 'structured_ranking_signal' else 'post_install_prediction' end as evidence_type,
  round(case when not allow then 1.0 when combined is null then structured else combined end, 9) as risk_score, not allow or coalesce(risk, false) as risk_detected,
  case when not allow then 'dependency resolution' when combined is null then 'not assessed' when i >= s then 'import' else 'smoke test' end as likely_stage,
  case when combined is null then 'not_scored' else 'covered' end as model_coverage from c
""",
    "observations",
)
def _(t: Tables) -> DataFrame:
    return sc.pair_risk(decided(t)).select(
        "experiment_id",
        "part_key",
        "bytes",
        "evidence_type",
        F.round("risk_score", 9).alias("risk_score"),
        "risk_detected",
        "likely_stage",
        "model_coverage",
    )


@query(
    "embed_texts",
    r"""
select doc_id, case when ok then 32 end as width, case when ok then 1.0::double end as length, case when not ok then 'text has no tokens' end as violation
from (select doc_id, coalesce(regexp_matches(text, '[^\s\x0b\x{85}\p{Z}]'), false) as ok from documents)
""",
)
def _(t: Tables) -> DataFrame:
    encoded = tx.embed_texts(t.documents, ["doc_id"], tx.hashing_encoder(32))
    v = F.col("embedding")
    return encoded.select(
        "doc_id", F.when(v.isNotNull(), F.size(v)).alias("width"), F.round(norm(v), 6).alias("length"), "violation"
    )


