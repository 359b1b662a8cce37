import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from pinlattice.operators import boosting as bst
from pinlattice.operators import catalog as cat
from pinlattice.operators import folds, matrix, metrics, models, preprocess
from pinlattice.operators import observations as obs
from pinlattice.operators.ordered import exact_quantiles, ordered
from pinlattice.operators.skew import spread_join
from pinlattice.operators.texts import embedding_problems, package_mentions, resume_guard
from pinlattice.operators.violations import ContractError, require_empty


def skewed(spark, n=4000, seed=1):
    """One key holds a third of the rows and values tie heavily."""
    r = random.Random(seed)
    data = [
        (i, "hot" if r.random() < 0.34 else f"k{r.randrange(40)}", float(r.randrange(60)), r.randrange(2))
        for i in range(n)
    ]
    return spark.createDataFrame(data, "id bigint, key string, value double, label int").repartition(7)


def test_ordered_matches_pandas_under_skew(spark):
    df = skewed(spark)
    out = ordered(
        df, [F.col("value").desc(), F.col("id")], ["key"], group_size="size", totals={"upto": "label"}
    ).toPandas()
    pdf = df.toPandas().sort_values(["key", "value", "id"], ascending=[True, False, True])
    pdf["position"] = pdf.groupby("key").cumcount() + 1
    pdf["upto"] = pdf.groupby("key")["label"].cumsum()
    pdf["size"] = pdf.groupby("key")["id"].transform("size")
    both = out.merge(pdf, on="id", suffixes=("", "_p"))
    assert len(both) == len(pdf)
    for c in ("position", "upto", "size"):
        assert (both[c] == both[f"{c}_p"]).all()
    every = ordered(df, [F.col("value"), F.col("id")], group_size="n").toPandas()
    assert sorted(every["position"]) == list(range(1, len(pdf) + 1)) and (every["n"] == len(pdf)).all()
    again = every.sort_values("position")
    assert again[["value", "id"]].apply(tuple, axis=1).is_monotonic_increasing


def test_ordered_keeps_null_groups(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a")], "id int, key string")
    out = ordered(df, [F.col("id")], ["key"], group_size="n")
    assert rows(out, "id", "position", "n") == [(1, 1, 2), (2, 2, 2), (3, 1, 1)]


@pytest.mark.parametrize("method", ["linear", "nearest"])
def test_exact_quantiles(spark, method):
    df = skewed(spark)
    probs = {"a": 0.0, "b": 0.37, "c": 0.5, "d": 0.9, "e": 1.0}
    out = {r["key"]: r for r in exact_quantiles(df, "value", probs, ["key"], method).collect()}
    for key, part in df.toPandas().groupby("key"):
        values = np.sort(part["value"].to_numpy())
        for name, p in probs.items():
            want = (
                np.quantile(values, p)
                if method == "linear"
                else values[max(0, int(np.ceil(len(values) * p)) - 1)]
            )
            assert out[key][name] == pytest.approx(want)


def test_spread_join_equals_plain_join(spark):
    left, right = skewed(spark, 600, 1).select("id", "key"), skewed(spark, 300, 2).select(F.col("id").alias("rid"), "key")
    want = sorted(tuple(r) for r in left.join(right, "key").select("id", "rid").collect())
    got = sorted(tuple(r) for r in spread_join(left, right, ["key"], rows_per_cell=20).select("id", "rid").collect())
    assert got == want


# Observation log ---------------------------------------------------------

LOG = "experiment_id string, outcome string"


def test_pending_keeps_infrastructure_failures(spark):
    log = spark.createDataFrame(
        [("one", "pass"), ("two", "wheel_unavailable"), ("retry-me", "infrastructure_failure")], LOG
    )
    specs = spark.createDataFrame([("one",), ("two",), ("retry-me",), ("new",)], "experiment_id string")
    assert rows(obs.pending(specs, log)) == [("new",), ("retry-me",)]


def test_repair_drops_every_duplicate(spark):
    log = spark.createDataFrame(
        [("good", "pass"), ("twice", "pass"), ("twice", "import_failure"), ("infra", "infrastructure_failure")], LOG
    )
    assert rows(obs.repair_results(log)) == [("good", "pass")]
    s = obs.repair_summary(log).first()
    assert (s["duplicate_ids"], s["infrastructure_only_ids"], s["output_rows"]) == (1, 1, 1)


def test_seed_is_idempotent_and_reports_conflicts(spark):
    schema = f"{LOG}, at int"
    matrix_ = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "experiment_id string, matrix_order int")
    one = spark.createDataFrame([("b", "pass", 1), ("a", "pass", 1)], schema)
    two = spark.createDataFrame([("b", "pass", 1)], schema)
    first, problems = obs.seed_results(matrix_, [one, two], ["at"])
    assert problems.count() == 0
    assert [r["experiment_id"] for r in first.orderBy("matrix_order").collect()] == ["a", "b"]
    again, _ = obs.seed_results(matrix_, [one, two], ["at"], first.select(*one.columns))
    assert rows(again) == rows(first)
    bad = spark.createDataFrame([("b", "import_failure", 1), ("zz", "pass", 1)], schema)
    _, problems = obs.seed_results(matrix_, [one, bad], ["at"])
    assert rows(problems, "rule", "key") == [("conflicting_rows", "b"), ("outside_matrix", "zz")]
    with pytest.raises(ContractError):
        require_empty(problems, "seed")


def test_structural_audit(spark):
    matrix_ = spark.createDataFrame([("a",), ("b",)], "experiment_id string")
    schema = f"{LOG}, measured boolean, calculated_id string"
    good = spark.createDataFrame([("a", "pass", True, "a"), ("b", "timeout", True, "b")], schema)
    r = obs.structural_audit(matrix_, good).first()
    assert r["structural_valid"] and r["complete"]
    infra = "infrastructure_failure"
    bad = spark.createDataFrame([("a", infra, True, "a"), ("a", infra, True, "a")], schema)
    r = obs.structural_audit(matrix_, bad).first()
    assert (r["duplicate_count"], r["infrastructure_failure_count"], r["missing_count"]) == (1, 2, 1)
    assert not r["structural_valid"] and not r["complete"]


# Matrix and catalog ------------------------------------------------------


def scope_rows(spark, packages, versions, pythons, hole):
    data = [
        (p, f"{v}.0", py, (p, v, py) not in hole, "eligible" if (p, v, py) not in hole else "wheel_unavailable", v)
        for p in packages for v in range(versions) for py in pythons
    ]
    return spark.createDataFrame(
        data, "package string, version string, python_version string, eligible boolean, reason string, version_order int"
    )


def test_matrix_counts_order_and_shards(spark):
    pythons = ["3.9", "3.10"]
    scope = scope_rows(spark, ["a", "b", "c"], 3, pythons, {("a", 0, "3.9"), ("b", 1, "3.10")})
    families = spark.createDataFrame(
        [("ab", "a", "b"), ("bc", "b", "c")], "family string, package_a string, package_b string"
    )
    full = matrix.experiment_matrix(scope, families)
    runnable, excluded = matrix.split_coverage(full)
    assert full.count() == 36 and full.select("experiment_id").distinct().count() == 36
    assert runnable.count() + excluded.count() == 36 and excluded.count() == 3 + 3 + 3
    assert rows(matrix.experiment_matrix(scope, families, True), "experiment_id") == rows(runnable, "experiment_id")
    placed = matrix.matrix_order(runnable)
    listed = placed.orderBy("matrix_order").collect()
    assert [r["matrix_order"] for r in listed] == list(range(1, 28))
    assert listed[0]["family"] == "ab" and listed[0]["python_version"] == "3.9"
    sharded = matrix.assign_shards(placed, 10)
    s = matrix.shard_summary(sharded).first()
    assert (s["shards"], s["rows"], s["first_size"], s["last_size"]) == (3, 27, 10, 7)
    assert sharded.filter("matrix_order = 11").first()["shard_name"] == "shard-02-of-03"
    assert all(r["reconciled"] for r in matrix.matrix_reconcile(scope, families, full).collect())


def test_select_and_spread_versions(spark):
    data = [("p", f"1.{i}.0") for i in range(10)]
    releases = spark.createDataFrame(data, "package string, version string")
    spread = cat.spread_select(releases, 4)
    assert rows(spread, "rank") == [(0,), (3,), (6,), (9,)]
    assert rows(cat.spread_select(releases, 1), "version") == [("1.9.0",)]
    kept = spark.createDataFrame([("p", "1.0.0"), ("p", "1.1.0"), ("p", "8.8.8")], "package string, version string")
    chosen, problems = cat.select_versions(releases, kept, 4)
    assert rows(chosen, "version") == [("1.0.0",), ("1.1.0",), ("1.8.0",), ("1.9.0",)]
    assert problems.count() == 0
    chosen, problems = cat.select_versions(releases, kept, 1)
    assert chosen.count() == 0 and rows(problems, "rule") == [("preserved_exceed_target",)]


def test_release_rank_orders_numerically(spark):
    releases = spark.createDataFrame(
        [("p", v) for v in ("1.10", "1.9", "2.0rc1", "weird", "1.9")], "package string, version string"
    )
    got = {r["version"]: (r["rank"], r["is_latest"]) for r in cat.release_rank(releases).collect()}
    assert got == {"1.9": (0, False), "1.10": (1, False), "2.0rc1": (2, False), "weird": (3, True)}


def test_ranking_first_name_wins(spark):
    data = [("My_Package", 9, 0), ("my.package", 8, 1), ("Other", 7, 2)]
    ranked = cat.rank_projects(spark.createDataFrame(data, "project string, download_count bigint, listed int"))
    assert rows(ranked) == [("my-package", 9, 1), ("other", 7, 2)]


# Metrics -----------------------------------------------------------------


def brute_auc(y, s):
    ranks = pd.Series(s).rank(method="average").to_numpy()
    p, q = y.sum(), len(y) - y.sum()
    return (ranks[y == 1].sum() - p * (p + 1) / 2) / (p * q)


def brute_threshold(y, s):
    best = None
    for t in np.unique(np.concatenate(([0.0, 0.5, 1.0], s))):
        hit = s >= t
        tp, fp = (hit & (y == 1)).sum(), (hit & (y == 0)).sum()
        recall, spec = tp / y.sum(), 1 - fp / (len(y) - y.sum())
        key = ((recall + spec) / 2, recall, -abs(t - 0.5))
        if best is None or key > best[0]:
            best = (key, t)
    return best[1]


def test_rank_metrics_against_numpy(spark):
    df = skewed(spark, 1500).withColumn("score", F.col("value") / 60)
    auc = {r["key"]: r["roc_auc"] for r in metrics.roc_auc(df, "score", "label", ["key"]).collect()}
    ap = {r["key"]: r["average_precision"] for r in metrics.average_precision(df, "score", ["id"], "label", ["key"]).collect()}
    th = {r["key"]: r["threshold"] for r in metrics.select_threshold(df, "score", "label", ["key"]).collect()}
    for key, part in df.toPandas().sort_values("id").groupby("key"):
        y, s = part["label"].to_numpy(), part["score"].to_numpy()
        assert auc[key] == pytest.approx(brute_auc(y, s))
        ordered_y = y[np.argsort(-s, kind="stable")]
        precision = np.cumsum(ordered_y) / (np.arange(len(y)) + 1)
        assert ap[key] == pytest.approx((precision * ordered_y).sum() / y.sum())
        assert th[key] == pytest.approx(brute_threshold(y, s))
    single = df.filter("label = 1")
    assert np.isnan(metrics.roc_auc(single, "score", "label").first()[0])


def test_operating_point_against_numpy(spark):
    df = skewed(spark, 800).withColumns({"score": F.col("value") / 60, "base": (F.col("id") % 9 == 0).cast("int")})
    got = metrics.select_operating_point(df, "score", "base", 0.49, "label").first()
    pdf = df.toPandas()
    y, s, b = (pdf[c].to_numpy() for c in ("label", "score", "base"))
    best = None
    for t in np.unique(np.concatenate(([0.0, 1.0], s))):
        hit = (b == 1) | (s >= t)
        tp, fp, fn = (hit & (y == 1)).sum(), (hit & (y == 0)).sum(), (~hit & (y == 1)).sum()
        tn = len(y) - tp - fp - fn
        precision, recall = tp / max(tp + fp, 1), tp / (tp + fn)
        if precision + 1e-12 < 0.49:
            continue
        key = (recall, 2 * precision * recall / (precision + recall), (recall + tn / (tn + fp)) / 2, -t)
        if best is None or key > best[0]:
            best = (key, t)
    assert got["threshold"] == pytest.approx(best[1])


def test_binary_literal(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (1, 0, 0.4), (0, 1, 0.6), (0, 0, 0.1)], "actual int, predicted int, probability double")
    r = metrics.binary_metrics(df).first()
    assert (r["true_positive"], r["false_positive"], r["true_negative"], r["false_negative"]) == (1, 1, 1, 1)
    assert r["balanced_accuracy"] == 0.5


def test_multiclass_literal(spark):
    classes = ("pass", "resolution_failure", "import_failure", "smoke_test_failure")
    data = [
        ("pass", [0.9, 0.05, 0.03, 0.02]),
        ("import_failure", [0.2, 0.6, 0.1, 0.1]),
        ("smoke_test_failure", [0.1, 0.1, 0.1, 0.7]),
    ]
    r = metrics.multiclass_metrics(spark.createDataFrame(data, "outcome string, p array<double>"), classes).first()
    assert (r["import_failure_detected"], r["import_failure_correct_stage"]) == (1, 0)
    assert (r["smoke_test_failure_correct_stage"], r["false_positive"]) == (1, 0)


def test_mixed_radix_numbers_equal_the_sorted_matrix(spark):
    import random

    r = random.Random(3)
    data = []
    for package in ("a", "b", "c", "lonely"):
        for python in ("3.9", "3.10", "3.11"):
            for i in range(r.randrange(0, 9)):
                data.append((package, f"1.{i}", python, r.random() < 0.7, "eligible" if i % 2 else "yanked", 10 - i))
    scope = spark.createDataFrame(data, "package string, version string, python_version string, eligible boolean, reason string, version_order int")
    families = spark.createDataFrame([("z", "a", "b"), ("y", "b", "c"), ("x", "a", "a"), ("w", "a", "unknown")], "family string, package_a string, package_b string")
    for runnable in (False, True):
        want = rows(matrix.matrix_order(matrix.experiment_matrix(scope, families, runnable)), "family", "experiment_id", "matrix_order")
        got = matrix.numbered_matrix(scope, families, runnable)
        assert rows(got, "family", "experiment_id", "matrix_order") == want
    full = matrix.experiment_matrix(scope, families)
    keys = ["family", "python_version", "eligible", "reason_a", "reason_b"]
    assert rows(matrix.matrix_counts(scope, families), *keys, "rows") == rows(full.groupBy(*keys).count().withColumnRenamed("count", "rows"))
    assert all(x["reconciled"] for x in matrix.matrix_reconcile(scope, families).collect())
    assert matrix.numbered_matrix(scope.limit(0), families).count() == 0


def test_class_weights(spark):
    data = [(label,) for label, n in enumerate((12, 6, 3, 1)) for _ in range(n)]
    out = preprocess.root_weights(spark.createDataFrame(data, "label int"), "label", 4).orderBy("label").collect()
    w = [r["weight"] for r in out]
    assert w == sorted(w) and np.mean(w) == pytest.approx(1.0)


def greedy(groups, k):
    n, f = sum(g[1] for g in groups), sum(g[2] for g in groups)
    goal_n, goal_f = n / k, max(1.0, f / k)
    state, out = [[0, 0, 0] for _ in range(k)], {}
    for name, rows_, fails in sorted(groups, key=lambda g: (-g[1], -g[2], g[0])):
        pick = min(range(k), key=lambda i: (((state[i][0] + rows_) / goal_n) ** 2 + ((state[i][1] + fails) / goal_f) ** 2, state[i][2] + 1, i))
        state[pick] = [state[pick][0] + rows_, state[pick][1] + fails, state[pick][2] + 1]
        out[name] = pick + 1
    return out


def test_balanced_folds(spark):
    r = random.Random(3)
    data = [(f"f{i}", int(r.random() < 0.3)) for i in range(23) for _ in range(r.randrange(1, 40))]
    counts = defaultdict(lambda: [0, 0])
    for name, y in data:
        counts[name][0] += 1
        counts[name][1] += y
    df = spark.createDataFrame(data, "family string, actual int")
    got = {x["family"]: x["fold"] for x in folds.balanced_fold_map(df, 4).collect()}
    assert got == greedy([(n, a, b) for n, (a, b) in counts.items()], 4)
    many = [(f"g{i}", 2 + i // 700, i // 1100) for i in range(1500)] + [("h", 900, 0), ("i", 40, 40)]
    df2 = spark.createDataFrame(many, "family string, n int, p int").select(
        "family", F.explode(F.sequence(F.lit(1), "n")).alias("i"), "p"
    ).select("family", (F.col("i") <= F.col("p")).cast("int").alias("actual"))
    assert {x["family"]: x["fold"] for x in folds.balanced_fold_map(df2, 3).collect()} == greedy(many, 3)
    assert folds.balanced_fold_map(df.limit(0), 3).count() == 0
    assert folds.balanced_folds(df, 4).groupBy("family").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count() == 0


# Models ------------------------------------------------------------------


def test_preprocessor_matches_pandas(spark):
    pdf = pd.DataFrame({"x": [1.0, None, 3.0, 10.0], "flag": ["True", "False", None, "true"], "c": ["b", None, "a", "b"]})
    df = spark.createDataFrame([tuple(None if pd.isna(v) else v for v in row) for row in pdf.to_numpy()], "x double, flag string, c string")
    p = preprocess.fit_preprocessor(df, ["x", "flag"], ["c"])
    filled = pdf["x"].fillna(3.0)
    assert p.medians == {"x": 3.0, "flag": 1.0}
    assert p.means["x"] == pytest.approx(filled.mean()) and p.scales["x"] == pytest.approx(filled.std(ddof=0))
    assert p.levels == {"c": ("<missing>", "a", "b")}
    other = spark.createDataFrame([(3.0, "true", "zzz")], "x double, flag string, c string")
    assert p.transform(other).first()["features"][2:] == [0.0, 0.0, 0.0]
    assert rows(preprocess.unknown_categories(other, p.levels)) == [("c", "zzz")]


def test_bins_match_numpy(spark):
    r = np.random.default_rng(5)
    values = np.round(r.normal(size=(300, 2)), 1)
    df = spark.createDataFrame([(list(map(float, v)),) for v in values], "x array<double>")
    cuts = preprocess.fit_bins(df, "x", 24)
    for i in range(2):
        want = np.unique(np.quantile(values[:, i], np.linspace(0, 1, 25)[1:-1]))
        want = want[(want > values[:, i].min()) & (want < values[:, i].max())]
        assert cuts[i] == pytest.approx(list(want))
    got = [b["b"] for b in df.select("x", preprocess.bin_values(F.col("x"), cuts).alias("b")).collect()]
    want = [[int(np.searchsorted(cuts[i], v[i], side="right")) for i in range(2)] for v in values]
    assert got == want


def test_boosting_learns_and(spark):
    data = [([float(a), float(b)], int(a and b), [a, b]) for a in (0, 1) for b in (0, 1) for _ in range(40)]
    df = spark.createDataFrame(data, "x array<double>, label int, bins array<int>")
    options = bst.BoostingOptions(trees=12, learning_rate=0.3, depth=2, minimum_leaf=5, feature_fraction=1.0)
    head = bst.fit_boosting(df, 2, options)
    scored = bst.score_heads(df, {"h": head}, [[0.5], [0.5]], "x")
    right = scored.agg(F.avg(((F.col("probability") >= 0.5).cast("int") == F.col("label")).cast("double"))).first()[0]
    assert right > 0.99
    again = bst.BoostedHead.from_payload(head.payload())
    assert rows(bst.score_heads(df, {"h": again}, [[0.5], [0.5]], "x"), "probability") == rows(scored, "probability")


def newton_tree(bins, g, h, depth, leaf, l2):
    """Plain depth-first reference of one tree without feature sampling."""
    out = np.empty(len(g))

    def grow(idx, d):
        value = np.clip(g[idx].sum() / (h[idx].sum() + l2), -5, 5)
        best = None
        if d < depth and len(idx) >= 2 * leaf:
            for f in range(bins.shape[1]):
                for b in range(bins[idx, f].max()):
                    left = idx[bins[idx, f] <= b]
                    right = idx[bins[idx, f] > b]
                    if len(left) < leaf or len(right) < leaf:
                        continue
                    gain = sum(g[i].sum() ** 2 / (h[i].sum() + l2) for i in (left, right))
                    gain -= g[idx].sum() ** 2 / (h[idx].sum() + l2)
                    if gain > 1e-7 and (best is None or gain > best[0] + 1e-9):
                        best = (gain, left, right)
        if best is None:
            out[idx] = value
        else:
            grow(best[1], d + 1)
            grow(best[2], d + 1)

    grow(np.arange(len(g)), 0)
    return out


def test_boosting_matches_plain_newton_trees(spark):
    r = np.random.default_rng(11)
    bins = r.integers(0, 6, size=(240, 3))
    y = ((bins[:, 0] > 2) ^ (r.random(240) < 0.2)).astype(float)
    df = spark.createDataFrame(
        [(list(map(float, b)), int(v), list(map(int, b)), i) for i, (b, v) in enumerate(zip(bins, y))],
        "features array<double>, label int, bins array<int>, id int",
    )
    options = bst.BoostingOptions(trees=3, learning_rate=0.5, depth=2, minimum_leaf=10, feature_fraction=1.0, checkpoint_every=2)
    head = bst.fit_boosting(df, 3, options)
    rate = y.mean()
    logit = np.full(len(y), np.log(rate / (1 - rate)))
    for _ in range(3):
        p = 1 / (1 + np.exp(-logit))
        logit += 0.5 * newton_tree(bins, y - p, p * (1 - p), 2, 10, 2.0)
    cuts = [[k + 0.5 for k in range(5)]] * 3
    got = bst.score_heads(df, {"h": head}, cuts).orderBy("id").toPandas()["probability"].to_numpy()
    assert got == pytest.approx(1 / (1 + np.exp(-logit)), abs=1e-9)


def test_heads_need_both_classes(spark):
    df = spark.createDataFrame([([0], "pass"), ([1], "resolution_failure")] * 10, "bins array<int>, outcome string")
    with pytest.raises(ValueError, match="import"):
        bst.fit_heads(df, 1, bst.STAGE_AWARE, bst.BoostingOptions(trees=1, minimum_leaf=2))


def test_projection_and_interactions(spark):
    r = np.random.default_rng(2)
    data = [("p", str(i), [float(x) for x in r.normal(size=3)]) for i in range(6)]
    emb = spark.createDataFrame(data, "package string, version string, embedding array<double>")
    projection = models.fit_projection(emb, emb, 2)
    m = np.array([d[2] for d in data])
    centred = m - m.mean(axis=0)
    _, _, right = np.linalg.svd(centred, full_matrices=False)
    want = np.abs(centred @ right[:2].T)
    got = emb.select("version", projection.project(F.col("embedding")).alias("x")).orderBy("version").collect()
    assert np.abs([r["x"] for r in got]) == pytest.approx(want, abs=1e-8)
    missing = spark.createDataFrame([("p", "nope")], "package string, version string")
    with pytest.raises(ValueError, match="missing"):
        models.fit_projection(emb, missing, 2)


def test_weighted_logistic_optimum(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(200, 2))
    y = (x[:, 0] + 0.5 * r.normal(size=200) > 0.8).astype(int)
    df = spark.createDataFrame([([float(a), float(b)], int(v)) for (a, b), v in zip(x, y)], "features array<double>, label int")
    model = models.fit_weighted_logistic(df)
    w = np.where(y == 1, 200 / (2 * y.sum()), 200 / (2 * (200 - y.sum())))
    p = 1 / (1 + np.exp(-(x @ np.array(model.weights) + model.intercept)))
    gradient = x.T @ (w * (p - y)) / w.sum() + 0.1 * np.array(model.weights) / 200
    assert np.abs(gradient).max() < 1e-4


def test_embedding_guards(spark):
    schema = "package string, version string, selected_text_sha256 string, model string, embedding array<double>"
    rows_ = [("p", "1", "h", "m", [3.0, 4.0]), ("p", "1", "h", "m", [1.0, 0.0]), ("q", "1", "h", "other", [0.0, 0.0])]
    found = rows(embedding_problems(spark.createDataFrame(rows_, schema)), "rule")
    assert found == [("duplicate_release",), ("invalid_vector",), ("mixed_model",)]
    source = spark.createDataFrame([("p", "1", "changed")], "package string, version string, selected_text_sha256 string")
    guard = resume_guard(spark.createDataFrame(rows_[1:], schema), source, "m", 3)
    assert rows(guard, "rule", "key") == [
        ("not_in_source", "q==1"), ("other_model", "q==1"), ("other_width", "p==1"), ("other_width", "q==1"), ("text_changed", "p==1"),
    ]


def test_equal_families_share_out_like_one_by_one(monkeypatch):
    r = random.Random(9)
    cases = []
    for _ in range(60):
        k = r.randrange(1, 6)
        loads = [(float(r.randrange(0, 300)), float(r.randrange(0, 40)), r.randrange(0, 9)) for _ in range(k)]
        size = (float(r.randrange(1, 9)), float(r.randrange(0, 3)))
        goals = (r.choice([1e3, 37.0, 1e9]), r.choice([1.0, 55.0]))
        cases.append((loads, size, goals, r.randrange(1, 400)))
    plain = [folds.share_out(*c) for c in cases]
    monkeypatch.setattr(folds, "_ONE_BY_ONE", 0)
    assert [folds.share_out(*c) for c in cases] == plain
    assert sum(folds.share_out([(0.0, 0.0, 0)] * 3, (2.0, 1.0), (1e9, 1e8), 10**9)) == 10**9


def test_mentions_with_more_names_than_the_filter_tells_apart(spark, monkeypatch):
    from pinlattice.operators import texts as module

    monkeypatch.setattr(module, "FILTER_WORDS", 1)
    texts = spark.createDataFrame([("n1", "1", "N1 n2 n3.x n3 n2 other"), ("z", "2", None)], "package string, version string, text string")
    vocabulary = spark.range(500).select(F.concat(F.lit("N"), "id").alias("name"))
    got = {r["version"]: r["package_mentions"] for r in package_mentions(texts, vocabulary, ["package", "version"]).collect()}
    assert got == {"1": {"N1": 1, "N2": 2, "N3": 2}, "2": {}}
    nothing = package_mentions(texts, vocabulary.limit(0), ["package", "version"])
    assert [r["package_mentions"] for r in nothing.collect()] == [{}, {}]


def test_mentions_whole_tokens_only(spark):
    texts = spark.createDataFrame(
        [("me", "1", "demo-client, not my-demo-client or demo-clients. ME zope.interface! zope.interface.x Demo-Client")],
        "package string, version string, text string",
    )
    vocabulary = spark.createDataFrame([("demo-client",), ("me",), ("zope.interface",), ("absent",)], "name string")
    r = package_mentions(texts, vocabulary, ["package", "version"]).first()
    assert r["package_mentions"] == {"demo-client": 2, "zope.interface": 2}
