"""Models of all folds at once against one fit per fold."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from pinlattice.operators import models as md
from pinlattice.operators.held_out import fit_design, fit_held_out, medians_without

NUMERIC, CATEGORICAL = ["x", "z"], ["kind"]


def training_rows(spark, n=600, folds=4, seed=1):
    r = random.Random(seed)
    data = []
    for i in range(n):
        x = None if r.random() < 0.2 else round(r.gauss(3, 2), 1)
        z, kind = float(r.randrange(50)), r.choice(["a", "b", None, "c"])
        fold = f"f{i % folds}"
        if i == 7:
            kind = "only-here"
        p = (x or 1) * 0.6 - z * 0.04 + (kind == "a") * 1.5 - 1 + r.gauss(0, 1)
        data.append((str(i), fold, x, z, kind, int(p > 0)))
    return spark.createDataFrame(data, "experiment_id string, fold string, x double, z double, kind string, actual int"), data


def test_medians_without_a_fold(spark):
    frame, data = training_rows(spark)
    skewed = frame.unionByName(frame.limit(0)).withColumn("w", F.when(F.col("fold") == "f1", F.lit(1.0)).otherwise(F.lit(None).cast("double")))
    got = {(r.fold, r.column): r.median for r in medians_without(skewed, ["x", "z", "w"]).collect()}
    assert len(got) == 12
    for f in ("f0", "f1", "f2", "f3"):
        for column, at in (("x", 2), ("z", 3)):
            assert got[f, column] == pytest.approx(statistics.median(d[at] for d in data if d[1] != f and d[at] is not None))
        assert got[f, "w"] == (None if f == "f1" else 1.0)


def test_joint_fits_equal_serial_fits(spark):
    frame, _ = training_rows(spark)
    frame = frame.cache()
    models = fit_held_out(frame, NUMERIC, CATEGORICAL)
    joint = {r.experiment_id: r.probability for r in models.score(frame).collect()}
    serial, problems = md.out_of_fold(frame, md.logistic_fit(NUMERIC, CATEGORICAL))
    expected = {r.experiment_id: r.probability for r in serial.collect()}
    assert problems.count() == 0 and joint.keys() == expected.keys()
    assert max(abs(joint[k] - expected[k]) for k in joint) < 1e-5
    assert models.rounds < 15


def test_rows_of_jobs_do_not_grow_with_folds(spark):
    tracker = spark.sparkContext.statusTracker()

    def jobs(folds):
        frame, _ = training_rows(spark, 400, folds)
        spark.sparkContext.setJobGroup(f"folds-{folds}", "")
        rounds = fit_held_out(frame, ["x", "z"], ["kind"]).rounds
        spark.sparkContext.setJobGroup("", "")
        return len(tracker.getJobIdsForGroup(f"folds-{folds}")), rounds

    (few, few_rounds), (many, many_rounds) = jobs(3), jobs(20)
    assert many - few <= 4 * max(many_rounds - few_rounds, 0) + 6


def test_rows_stay_where_they_are_when_folds_are_joined_and_scored(spark, capsys):
    from pinlattice.operators.folds import balanced_folds

    frame, _ = training_rows(spark, 400, 6)
    folded = balanced_folds(frame.withColumnRenamed("fold", "family"), 3)
    # Without statistics of their own the small tables are found by what the code says of them.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scored, _ = md.held_out_scores(folded, NUMERIC, CATEGORICAL)
        scored.select("probability").explain()
        plan = capsys.readouterr().out
        values = scored.select("fold", "probability").collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("BroadcastHashJoin") >= 2 and "SortMergeJoin" not in plan
    assert len(values) == 400 and {r.fold for r in values} == {1, 2, 3} and all(0 < r.probability < 1 for r in values)


def test_product_is_that_of_the_whole_vector(spark):
    from pinlattice.operators.held_out import _blocks, _packed

    frame, _ = training_rows(spark, 60, 3)
    design = fit_design(frame, NUMERIC, CATEGORICAL)
    weights = np.arange(1.0, design.width + 1)
    got = [r[0] for r in frame.select(design.product(frame, F.array(*map(F.lit, weights.tolist())))).collect()]
    packed = _packed(frame.coalesce(1), {"f0": 0, "f1": 1, "f2": 2}, "fold", "actual", design).toArrow()
    z = np.concatenate([z.T for _, _, z in _blocks(packed.to_batches(), design)])
    assert z.shape == (60, design.width)
    assert sorted(got) == pytest.approx(sorted((z @ weights).tolist()))


def test_folds_that_miss_a_class_and_rows_without_one(spark):
    frame, _ = training_rows(spark, 100, 2)
    one_sided = frame.withColumn("actual", (F.col("fold") == "f0").cast("int"))
    with pytest.raises(ValueError, match="miss a class"):
        fit_held_out(one_sided, NUMERIC, CATEGORICAL)
    loose = frame.withColumn("fold", F.when(F.col("experiment_id") != "3", F.col("fold")))
    _, problems = md.held_out_scores(loose, NUMERIC, CATEGORICAL)
    assert [(r.rule, r.key) for r in problems.collect()] == [("no_out_of_fold_score", "3")]


def test_design_limits_levels(spark):
    frame, _ = training_rows(spark, 50)
    assert fit_design(frame, NUMERIC, []).width == 5
    with pytest.raises(ValueError):
        fit_design(frame, [], ["experiment_id"], 10)


# The network --------------------------------------------------------------


def test_network_gradient_is_the_slope_of_the_loss():
    from pinlattice.operators.network import Network

    net = Network.start(("a", "b", "c"), 4, (5, 3), 1)
    rng = np.random.default_rng(2)
    x, y, w = rng.normal(size=(7, 4)), rng.integers(0, 3, 7), rng.uniform(0.5, 2, 7)
    _, g = net.gradient(net.weights, x, y, w)
    for i in range(0, len(g), 3):
        step = np.zeros(len(g))
        step[i] = 1e-6
        slope = (net.gradient(net.weights + step, x, y, w)[0] - net.gradient(net.weights - step, x, y, w)[0]) / 2e-6
        assert g[i] == pytest.approx(slope, abs=1e-5)


def test_network_learns_and_refuses_strangers(spark):
    from pinlattice.operators.network import class_weights, fit_network, score_network

    r = random.Random(1)
    points = [(r.uniform(-1, 1), r.uniform(-1, 1)) for _ in range(800)]
    data = [([x, y], "same" if (x > 0) == (y > 0) else "other" if x > -0.7 else "rare") for x, y in points]
    frame = spark.createDataFrame(data, "features array<double>, outcome string").repartition(3)
    classes = ("same", "other", "rare")
    network = fit_network(frame, classes, 2, (16, 8), 40)
    again = fit_network(frame, classes, 2, (16, 8), 40)
    assert np.allclose(network.weights, again.weights)
    hits = score_network(frame, network).withColumn("best", F.array_position("p", F.array_max("p")))
    right = hits.filter(F.col("best") == F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("outcome"))).count()
    assert right / 800 > 0.9
    w = class_weights([100, 10, 1])
    assert w[2] > w[1] > w[0] and w.mean() == pytest.approx(1.0)
    unknown = frame.unionByName(spark.createDataFrame([([0.0, 0.0], None)], frame.schema))
    with pytest.raises(ValueError, match="no class"):
        fit_network(unknown, classes, 2, (4,), 1)
    assert score_network(spark.createDataFrame([(None,)], "features array<double>"), network).first()["p"] is None


def test_siblings_by_subtraction_and_joint_heads_equal_single_heads(spark):
    from pinlattice.operators import boosting as bst

    r = random.Random(4)
    outcomes = ["pass", "pass", "resolution_failure", "import_failure", "smoke_test_failure"]
    data = []
    for _ in range(1500):
        bins = [r.randrange(6) for _ in range(4)]
        data.append((bins, outcomes[(bins[0] + (bins[1] > 2) * 2 + r.randrange(2)) % 5]))
    frame = spark.createDataFrame(data, "bins array<int>, outcome string").repartition(3)
    options = bst.BoostingOptions(trees=5, learning_rate=0.4, minimum_leaf=20, checkpoint_every=2)
    joint = bst.fit_heads(frame, 4, bst.STAGE_AWARE, options)
    for head in bst.STAGE_AWARE:
        alone = bst.fit_heads(frame, 4, (head,), options)[head]
        for a, b in zip(alone.trees, joint[head].trees, strict=True):
            assert [(n.feature, n.split_bin, n.left, n.right) for n in a] == [(n.feature, n.split_bin, n.left, n.right) for n in b]
            assert [n.value for n in a] == pytest.approx([n.value for n in b])


def test_network_reads_packed_blocks_in_every_step(spark, monkeypatch):
    """Rows are converted once; steps read a byte string per block, not a value at a time."""
    from pinlattice.operators import network as nw

    kept = []
    real = nw.materialize
    monkeypatch.setattr(nw, "materialize", lambda df: kept.append(real(df)) or kept[-1])
    rows = [([float(i % 7), float(i % 3)], "pass" if i % 2 else "fail") for i in range(400)]
    frame = spark.createDataFrame(rows, "features array<double>, outcome string")
    nw.fit_network(frame, ["pass", "fail"], 2, (4,), 1)
    (packed,) = kept
    assert packed.dtypes == [("x", "binary"), ("y", "binary")]
    assert packed.count() < 400
    assert packed.selectExpr("sum(length(y)) / 8").first()[0] == 400


def test_smooth_rectifier_and_slope():
    import numpy as np

    from pinlattice.operators.network import _gelu

    x = np.array([-900.0, -40.0, -3.0, -0.5, 0.0, 0.5, 3.0, 40.0, 900.0])
    inner = np.tanh((2 / np.pi) ** 0.5 * (x + 0.044715 * x**3))
    value, slope = _gelu(x)
    assert np.allclose(value, 0.5 * x * (1 + inner), atol=1e-12)
    near = (_gelu(x + 1e-6)[0] - _gelu(x - 1e-6)[0]) / 2e-6
    assert np.allclose(slope, near, atol=1e-6)


def test_boosting_state_is_packed_blocks(spark):
    """A block per batch, bins as bytes: a pass reads no row by itself."""
    import numpy as np

    from pinlattice.operators import boosting as bst

    rows = [([i % 5, i % 300], [float(i % 2)], [1.0]) for i in range(600)]
    frame = spark.createDataFrame(rows, "bins array<int>, y array<double>, w array<double>").coalesce(1)
    for bins, size in ((256, 1), (300, 4)):
        frame_of = frame.filter("bins[1] < 256") if bins == 256 else frame
        n = frame_of.count()
        (block,) = bst._packed_rows(frame_of, 2, bins, [0.25]).collect()
        assert [len(block[c]) for c in ("bins", "y", "w", "logits")] == [2 * n * size, 8 * n, 8 * n, 8 * n]
        assert np.frombuffer(bytes(block["logits"])).tolist() == [0.25] * n


def test_preprocessor_table_does_not_gather_a_column_in_one_task(spark):
    """The medians go to the values: joined by column, all values of a column would meet in one task."""
    from pinlattice.operators.preprocess import preprocessor_table

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table = preprocessor_table(spark.createDataFrame([(1.0, 5.0), (None, 7.0), (4.0, 9.0)], "x double, y double"), ["x", "y"])
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [column" not in plan and "BroadcastHashJoin [column" in plan
        got = {r["column"]: (r["median"], round(r["mean"], 4), round(r["scale"], 4)) for r in table.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got == {"x": (2.5, 2.5, 1.2247), "y": (7.0, 7.0, 1.633)}


def test_boosting_refuses_null_bins(spark):
    from pinlattice.operators import boosting as bst

    rows = [([0, None], 0), ([1, 1], 1)] * 5
    frame = spark.createDataFrame(rows, "bins array<int>, label int")
    with pytest.raises(Exception, match="a bin is null"):
        bst.fit_boosting(frame, 2, bst.BoostingOptions(trees=1, minimum_leaf=1))


def test_a_pass_of_boosting_has_a_round_of_tasks_and_narrow_rows(spark, monkeypatch):
    """Starting a task costs more than its rows of a pass; labels and weights of all heads are a byte a row."""
    from pinlattice.operators import boosting as bst

    kept = []
    real = bst.materialize
    monkeypatch.setattr(bst, "materialize", lambda df: kept.append(real(df)) or kept[-1])
    outcomes = ["pass", "resolution_failure", "import_failure", "smoke_test_failure"]
    frame = spark.createDataFrame([([i % 5, i % 3], outcomes[i % 7 % 4]) for i in range(900)], "bins array<int>, outcome string")
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        bst.fit_heads(frame, 2, bst.STAGE_AWARE, bst.BoostingOptions(trees=2, minimum_leaf=5, checkpoint_every=1))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    assert len(kept) == 2
    for state in kept:
        assert state.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
        columns = [F.length(c) for c in state.columns if c != "kinds"]
        assert state.agg(F.sum(sum(columns[1:], columns[0]))).first()[0] == 900 * (2 + 1 + 3 * 8)


def test_shared_histograms_are_those_of_each_feature(spark):
    from pinlattice.operators import boosting as bst

    r = random.Random(9)
    levels = [20, 1, 24, 2, 2, 11, 2, 300]
    assert len(bst._shared(levels)) == 2
    data = [([r.randrange(n) for n in levels], [float(r.randrange(2)), 0.0], [r.random(), float(r.randrange(2))]) for _ in range(700)]
    frame = spark.createDataFrame(data, "bins array<int>, y array<double>, w array<double>").repartition(3)
    rows = bst._packed_rows(frame, len(levels), max(levels), [0.3, -0.2])
    tree = [bst.Node(0.0, 0, 9, 1, 2), bst.Node(0.5), bst.Node(0.0, 7, 150, 3, 4), bst.Node(-1.0), bst.Node(2.0)]
    found = bst._histograms(bst._pointed(rows, 2), levels, [[tree], []], [0.1, 0.1], [tree, [bst.Node(0.0)]], [[1, 4], [0]])

    def place(b):
        return 1 if b[0] <= 9 else 3 if b[7] <= 150 else 4

    assert sorted(found) == [(0, 1), (0, 4), (1, 0)]
    for (h, i), sums in found.items():
        expected = np.zeros((3, len(levels), max(levels)))
        for b, y, w in data:
            if w[h] and (h == 1 or place(b) == i):
                p = 1 / (1 + np.exp(-(-0.2 if h else 0.3 + 0.1 * tree[place(b)].value)))
                for f, at in enumerate(b):
                    expected[:, f, at] += (w[h] * (y[h] - p), w[h] * p * (1 - p), 1)
        assert np.allclose(sums, expected)


def test_bins_are_compared_in_compiled_code(spark):
    from pinlattice.operators import preprocess

    nan = float("nan")
    rows = [([1.0, nan, None],), ([None] * 3,), (None,), ([1.0, 2.0],), ([1.0, 2.0, 3.0, 4.0],), ([0.5, -0.0, 9.0],), ([],)]
    frame = spark.createDataFrame(rows, "v array<double>")
    found = frame.select(preprocess.bin_values(F.col("v"), [[0.5, 1.0], [0.0], []]).alias("b"))
    assert [r.b for r in found.collect()] == [[2, 1, 0], [0, 0, 0], None, [2, 1, 0], [2, 1, 0, None], [1, 1, 0], [0, 0, 0]]
    assert "CASE WHEN" in found._jdf.queryExecution().optimizedPlan().toString()
