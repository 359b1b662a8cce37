"""Evaluation metrics, thresholds and operating points.

Everything that depends on the order of scores works on one row per distinct
score, so millions of tied scores become one row before anything is sorted.
Every operator takes ``by``: the columns of independent evaluation groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pinlattice.constants import FAILURE_OUTCOMES, IMPROVEMENT_METRICS
from pinlattice.operators.ordered import attach_by, ordered, value_counts
from pinlattice.operators.violations import explode_rules, union_all, violation

Z95 = 1.959963984540054


def ratio(numerator: Column, denominator: Column) -> Column:
    """0 when the denominator is 0."""
    return F.coalesce(numerator / F.nullif(denominator.cast("double"), F.lit(0.0)), F.lit(0.0))


def confusion_metrics(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    specificity = ratio(tn, tn + fp)
    return {
        "accuracy": ratio(tp + tn, tp + fp + tn + fn),
        "balanced_accuracy": (recall + specificity) / 2,
        "precision": precision,
        "recall": recall,
        "f1": ratio(2 * precision * recall, precision + recall),
        "specificity": specificity,
    }


def _counts(actual: Column, predicted: Column) -> list[Column]:
    return [
        F.count_if(actual & predicted).alias("true_positive"),
        F.count_if(~actual & predicted).alias("false_positive"),
        F.count_if(~actual & ~predicted).alias("true_negative"),
        F.count_if(actual & ~predicted).alias("false_negative"),
    ]


def _confusion_columns() -> list[Column]:
    parts = [F.col(c) for c in ("true_positive", "false_positive", "true_negative", "false_negative")]
    return [c.alias(n) for n, c in confusion_metrics(*parts).items()]


def binary_metrics(
    df: DataFrame,
    actual: str = "actual",
    predicted: str = "predicted",
    by: Sequence[str] = (),
    positive: int = 1,
) -> DataFrame:
    """Confusion counts and rates of 0/1 columns; ``positive`` names the positive class."""
    counts = df.groupBy(*by).agg(
        *_counts(F.col(actual) == positive, F.col(predicted) == positive)
    )
    return counts.select("*", *_confusion_columns())


def probability_losses(
    df: DataFrame, actual: str = "actual", probability: str = "probability", by: Sequence[str] = ()
) -> DataFrame:
    """Log loss with probabilities clipped at 1e-12, and the Brier score."""
    y, p = F.col(actual).cast("double"), F.col(probability)
    clipped = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    loss = -(y * F.ln(clipped) + (1 - y) * F.ln(1 - clipped))
    return df.groupBy(*by).agg(
        F.avg(loss).alias("log_loss"), F.avg((p - y) * (p - y)).alias("brier_score")
    )


def score_table(
    df: DataFrame, score: str, actual: str = "actual", by: Sequence[str] = ()
) -> DataFrame:
    """One row per distinct score: n, positives and running totals from the lowest score."""
    counts = value_counts(df, score, by, {"positives": F.col(actual).cast("bigint")})
    return ordered(
        counts,
        [F.col(score)],
        by,
        position=None,
        totals={"n_upto": "n", "positives_upto": "positives"},
    )


def average_ranks(table: DataFrame, name: str = "average_rank") -> DataFrame:
    """Average rank of every distinct score of a ``score_table``."""
    return table.withColumn(name, F.col("n_upto") - F.col("n") + (F.col("n") + 1) / 2)


def rank_rows(df: DataFrame, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows with the average rank of their score."""
    counts = value_counts(df, score, by)
    ranked = average_ranks(
        ordered(counts, [F.col(score)], by, position=None, totals={"n_upto": "n"})
    )
    return df.join(ranked.select(*by, score, "average_rank"), [*by, score])


def roc_auc(df: DataFrame, score: str, actual: str = "actual", by: Sequence[str] = ()) -> DataFrame:
    """Rank-sum area with average ranks for ties; NaN for a single class."""
    table = average_ranks(score_table(df, score, actual, by))
    sums = table.groupBy(*by).agg(
        F.sum("positives").alias("p"),
        F.sum(F.col("n") - F.col("positives")).alias("q"),
        F.sum(F.col("average_rank") * F.col("positives")).alias("ranks"),
    )
    p, q = F.col("p"), F.col("q")
    area = (F.col("ranks") - p * (p + 1) / 2) / F.nullif((p * q).cast("double"), F.lit(0.0))
    return sums.select(*by, F.coalesce(area, F.lit(float("nan"))).alias("roc_auc"))


def precision_at_rank(
    df: DataFrame, score: str, order: Sequence[str], actual: str = "actual", by: Sequence[str] = ()
) -> DataFrame:
    """Rows by falling score with rank and precision; ties keep ``order`` (unique columns)."""
    labelled = df.withColumn("__label", F.col(actual).cast("bigint"))
    ranked = ordered(
        labelled,
        [F.col(score).desc(), *[F.col(c) for c in order]],
        by,
        position="rank",
        totals={"positives_upto": "__label"},
    )
    return ranked.withColumn("precision", F.col("positives_upto") / F.col("rank")).drop("__label")


def average_precision(
    df: DataFrame, score: str, order: Sequence[str], actual: str = "actual", by: Sequence[str] = ()
) -> DataFrame:
    """Mean precision at the ranks of the positives; NaN without positives."""
    rows = precision_at_rank(df, score, order, actual, by)
    y = F.col(actual).cast("bigint")
    area = F.sum(F.col("precision") * y) / F.nullif(F.sum(y).cast("double"), F.lit(0.0))
    return rows.groupBy(*by).agg(
        F.coalesce(area, F.lit(float("nan"))).alias("average_precision")
    )


def subtype_metrics(
    df: DataFrame, outcome: str = "outcome", predicted: str = "predicted", by: Sequence[str] = ()
) -> DataFrame:
    """Rows and recall per failure outcome, macro recall of those present, pooled post-install recall."""
    hit, kind = F.col(predicted).cast("double"), F.col(outcome)
    columns = []
    for name in FAILURE_OUTCOMES:
        columns += [
            F.count_if(kind == name).alias(f"{name}_rows"),
            F.avg(F.when(kind == name, hit)).alias(f"{name}_recall"),
        ]
    post = kind.isin("import_failure", "smoke_test_failure")
    table = df.groupBy(*by).agg(*columns, F.avg(F.when(post, hit)).alias("post_install_recall"))
    present = F.array_compact(F.array(*[F.col(f"{n}_recall") for n in FAILURE_OUTCOMES]))
    macro = F.when(
        F.size(present) > 0,
        F.aggregate(present, F.lit(0.0), lambda s, x: s + x) / F.size(present),
    )
    return table.withColumn("failure_subtype_macro_recall", macro)


def multiclass_metrics(
    df: DataFrame, classes: Sequence[str], outcome: str = "outcome", probabilities: str = "p"
) -> DataFrame:
    """Exact-stage accuracy and, per failure class, detection and exact-stage recall.

    ``probabilities`` is an array in the order of ``classes``, whose first entry
    is the pass class. A failure counts as detected when 1 - p(pass) >= 0.5.
    """
    p = F.col(probabilities)
    guess = F.element_at(
        F.array(*[F.lit(c) for c in classes]), F.array_position(p, F.array_max(p)).cast("int")
    )
    rows = df.select(
        F.col(outcome).alias("outcome"),
        guess.alias("guess"),
        (F.lit(1.0) - F.get(p, F.lit(0)) >= 0.5).alias("detected"),
    )
    actual = F.col("outcome") != classes[0]
    columns = [
        *_counts(actual, F.col("detected")),
        F.avg((F.col("guess") == F.col("outcome")).cast("double")).alias("exact_stage_accuracy"),
    ]
    for name in classes[1:]:
        same = F.col("outcome") == name
        columns += [
            F.count_if(same).alias(f"{name}_rows"),
            F.count_if(same & F.col("detected")).alias(f"{name}_detected"),
            F.count_if(same & (F.col("guess") == name)).alias(f"{name}_correct_stage"),
        ]
    table = rows.agg(*columns)
    present = F.lit(0)
    total = F.lit(0.0)
    for name in classes[1:]:
        n = F.col(f"{name}_rows")
        table = table.withColumn(
            f"{name}_detection_recall", ratio(F.col(f"{name}_detected"), n)
        ).withColumn(f"{name}_stage_recall", ratio(F.col(f"{name}_correct_stage"), n))
        present = present + (n > 0).cast("int")
        total = total + F.when(n > 0, F.col(f"{name}_detection_recall")).otherwise(0.0)
    return table.withColumn("macro_detection_recall", ratio(total, present))


def threshold_table(
    df: DataFrame,
    score: str,
    actual: str = "actual",
    by: Sequence[str] = (),
    fixed: Sequence[float] = (0.0, 0.5, 1.0),
    base: str | None = None,
) -> DataFrame:
    """Confusion counts of ``score >= threshold`` for every distinct score and fixed value.

    With ``base`` (0/1) the decision is ``base or score >= threshold``.
    """
    y = F.col(actual).cast("bigint")
    free = F.lit(True) if base is None else F.col(base) == 0
    scored = df.groupBy(*by, F.col(score).cast("double").alias("threshold")).agg(
        F.count_if(free).alias("n"),
        F.coalesce(F.sum(F.when(free, y)), F.lit(0)).alias("positives"),
        F.count_if(~free).alias("base_n"),
        F.coalesce(F.sum(F.when(~free, y)), F.lit(0)).alias("base_positives"),
    )
    groups = scored.groupBy(*by).agg(
        F.sum("n").alias("free_n"),
        F.sum("positives").alias("free_p"),
        F.sum("base_n").alias("all_base_n"),
        F.sum("base_positives").alias("all_base_p"),
    )
    zero = F.lit(0).cast("bigint")
    extra = groups.select(
        *by,
        F.explode(F.array(*[F.lit(float(v)) for v in fixed])).alias("threshold"),
        *[zero.alias(c) for c in ("n", "positives", "base_n", "base_positives")],
    )
    merged = (
        scored.unionByName(extra)
        .groupBy(*by, "threshold")
        .agg(F.sum("n").alias("n"), F.sum("positives").alias("positives"))
    )
    running = ordered(
        merged,
        [F.col("threshold")],
        by,
        position=None,
        totals={"n_upto": "n", "p_upto": "positives"},
    )
    running = attach_by(running, groups, by)
    below_n = F.col("n_upto") - F.col("n")
    below_p = F.col("p_upto") - F.col("positives")
    tp = F.col("all_base_p") + F.col("free_p") - below_p
    predicted = F.col("all_base_n") + F.col("free_n") - below_n
    table = running.select(
        *by,
        "threshold",
        tp.alias("true_positive"),
        (predicted - tp).alias("false_positive"),
        (below_n - below_p).alias("true_negative"),
        below_p.alias("false_negative"),
    )
    return table.select("*", *_confusion_columns())


def _best(table: DataFrame, key: Sequence[Column], by: Sequence[str]) -> DataFrame:
    columns = [c for c in table.columns if c not in by]
    best = table.groupBy(*by).agg(
        F.max_by(F.struct(*columns), F.struct(*[k.alias(f"k{i}") for i, k in enumerate(key)])).alias(
            "best"
        )
    )
    return best.select(*by, "best.*")


def select_threshold(
    df: DataFrame, score: str, actual: str = "actual", by: Sequence[str] = ()
) -> DataFrame:
    """Threshold with the best (balanced accuracy, failure recall, closeness to 0.5), lowest on ties."""
    t = F.col("threshold")
    return _best(
        threshold_table(df, score, actual, by),
        [F.col("balanced_accuracy"), F.col("recall"), -F.abs(t - 0.5), -t],
        by,
    )


def select_operating_point(
    df: DataFrame, score: str, base: str, minimum_precision: float, actual: str = "actual",
    by: Sequence[str] = (),
) -> DataFrame:
    """Best second-model threshold of the OR rule whose precision stays above a floor."""
    t = F.col("threshold")
    table = threshold_table(df, score, actual, by, fixed=(0.0, 1.0), base=base)
    return _best(
        table.filter(F.col("precision") + 1e-12 >= minimum_precision),
        [F.col("recall"), F.col("f1"), F.col("balanced_accuracy"), -t],
        by,
    )


def calibrate_post_install(
    df: DataFrame, score: str, outcome: str = "outcome", by: Sequence[str] = ()
) -> DataFrame:
    """On rows that resolved: best (F1, balanced accuracy, recall, fewer false warnings)."""
    resolved = df.filter(F.col(outcome) != "resolution_failure").withColumn(
        "__post", (F.col(outcome) != "pass").cast("int")
    )
    table = threshold_table(resolved, score, "__post", by)
    return _best(
        table,
        [
            F.col("f1"),
            F.col("balanced_accuracy"),
            F.col("recall"),
            -F.col("false_positive"),
            -F.col("threshold"),
        ],
        by,
    )


def select_candidate(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Best candidate row; ``listed`` breaks ties in favour of the first one listed."""
    return _best(
        metrics,
        [
            F.col("balanced_accuracy"),
            F.col("failure_subtype_macro_recall"),
            F.col("recall"),
            -F.col("brier_score"),
            -F.col("listed"),
        ],
        by,
    )


def wilson_interval(successes: Column, total: Column) -> tuple[Column, Column]:
    p = successes / total
    z2 = Z95 * Z95
    spread = Z95 * F.sqrt(p * (1 - p) / total + F.lit(z2) / (4 * total * total))
    centre, denominator = p + F.lit(z2) / (2 * total), 1 + F.lit(z2) / total
    return (centre - spread) / denominator, (centre + spread) / denominator


def improvement(model: DataFrame, baseline: DataFrame, metrics: Sequence[str] = IMPROVEMENT_METRICS, by: Sequence[str] = ()) -> DataFrame:
    """(by, metric, model, baseline, improvement): how far a model's metrics are above a baseline's.

    Both frames have one row per ``by`` group (one row without groups). A group
    that only one of them has stays with a null improvement.
    """

    def long(df: DataFrame, name: str) -> DataFrame:
        cells = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for m in metrics]
        return df.select(*by, F.explode(F.array(*cells)).alias("c")).select(*by, "c.*")

    joined = long(model, "model").join(long(baseline, "baseline"), [*by, "metric"], "full_outer")
    return joined.withColumn("improvement", F.col("model") - F.col("baseline"))


def baseline_metrics(train: DataFrame, test: DataFrame, actual: str = "actual") -> DataFrame:
    """Accuracy and balanced accuracy of three constant policies on the test rows."""
    y = F.col(actual).cast("double")
    rate = train.agg((F.avg(y) >= 0.5).alias("majority"))
    rates = test.agg(F.avg(y).alias("failure_rate"), F.count(F.lit(1)).alias("rows"))
    both = rates.join(F.broadcast(rate))
    majority = F.col("majority")
    return both.select(
        F.col("rows"),
        F.when(majority, F.col("failure_rate"))
        .otherwise(1 - F.col("failure_rate"))
        .alias("majority_class_accuracy"),
        (1 - F.col("failure_rate")).alias("always_pass_accuracy"),
        F.lit(0.5).alias("always_pass_balanced_accuracy"),
        F.col("failure_rate").alias("always_fail_accuracy"),
    )


def score_join(predictions: DataFrame, results: DataFrame, key: str = "experiment_id") -> tuple[DataFrame, DataFrame]:
    """(scored rows, violations): keys must match exactly and outcomes must be evaluable."""
    p = predictions.withColumn("__p", F.lit(True))
    r = results.select(key, "outcome").withColumn("__r", F.lit(True))
    joined = p.join(r, key, "full_outer")
    problems = explode_rules(
        joined,
        F.col(key),
        {
            "prediction_missing": F.col("__p").isNull(),
            "result_missing": F.col("__r").isNull(),
            "outcome_not_evaluable": F.col("__r").isNotNull()
            & ~F.coalesce(F.col("outcome").isin("pass", *FAILURE_OUTCOMES), F.lit(False)),
        },
    )
    rows = joined.filter("__p and __r").drop("__p", "__r")
    return rows.withColumn("actual", (F.col("outcome") != "pass").cast("int")), problems


def merge_one_to_one(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(inner merge, violations) where neither side may repeat a key."""
    problems = []
    for name, side in (("left", left), ("right", right)):
        repeated = side.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
        problems.append(violation(repeated, f"duplicate_{name}_key", F.col(key), F.col("n")))
    return left.join(right, key), union_all(problems)


def cascade_replay(
    df: DataFrame,
    constraint: str,
    structured: str,
    post: str,
    structured_threshold: float,
    post_threshold: float,
) -> DataFrame:
    """Decision of the three gates per row: ``reached`` names the last gate a row got to.

    Gates run in order: published constraint, structured risk, post-install risk.
    """
    blocked = ~F.coalesce(F.col(constraint), F.lit(False))
    risky = F.col(structured) >= structured_threshold
    post_risky = F.coalesce(F.col(post) >= post_threshold, F.lit(False))
    return df.withColumn(
        "reached",
        F.when(blocked, "constraint").when(risky, "structured").otherwise("post_install"),
    ).withColumn("predicted", (blocked | risky | post_risky).cast("int"))


def cascade_summary(replayed: DataFrame, outcome: str = "outcome") -> DataFrame:
    """Gate reach, metrics of the whole policy and recall per outcome in one aggregation."""
    actual, predicted = F.col(outcome) != "pass", F.col("predicted") == 1
    columns = [
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("reached") != "constraint").alias("reached_structured"),
        F.count_if(F.col("reached") == "post_install").alias("reached_post_install"),
        *_counts(actual, predicted),
    ]
    for name in ("pass", *FAILURE_OUTCOMES):
        right = ~predicted if name == "pass" else predicted
        columns.append(
            F.avg(F.when(F.col(outcome) == name, right.cast("double"))).alias(f"{name}_recall")
        )
    return replayed.agg(*columns).select("*", *_confusion_columns())
