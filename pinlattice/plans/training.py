"""Train, freeze and evaluate a structured model without re-tuning on blind rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinlattice.operators.folds import balanced_folds
from pinlattice.operators.metrics import (
    binary_metrics,
    probability_losses,
    score_join,
    select_candidate,
    select_threshold,
    subtype_metrics,
)
from pinlattice.operators.models import (
    LinearModel,
    fit_weighted_logistic,
    held_out_scores,
    prediction_drift,
    stack_candidates,
)
from pinlattice.operators.preprocess import Preprocessor, fit_preprocessor
from pinlattice.operators.violations import union_all
from pinlattice.plans.features import leakage_guard


@dataclass(frozen=True)
class FrozenStructuredModel:
    preprocessor: Preprocessor
    model: LinearModel

    def predict(self, df: DataFrame) -> DataFrame:
        probability = self.model.probability(self.preprocessor.features(df))
        return df.withColumn("probability", probability).withColumn(
            "predicted", (F.col("probability") >= self.model.threshold).cast("int")
        )


def fit_final(
    train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], folds: int = 5,
    label: str = "actual", key: str = "experiment_id",
) -> tuple[FrozenStructuredModel, DataFrame, DataFrame]:
    """(frozen model, out-of-fold rows, violations): the threshold comes from out-of-fold scores only.

    Rows without an out-of-fold score are reported and have no part in the threshold.
    """
    leakage_guard([*numeric, *categorical])
    folded = balanced_folds(train, folds, actual=label)
    scored, problems = held_out_scores(folded, numeric, categorical, key, label=label)
    threshold = select_threshold(scored.filter(F.col("probability").isNotNull()), "probability", label).first()["threshold"]
    preprocessor = fit_preprocessor(train, numeric, categorical)
    model = fit_weighted_logistic(preprocessor.transform(train), label=label)
    return FrozenStructuredModel(preprocessor, replace(model, threshold=threshold)), scored, problems


def evaluate_blind(
    stored: DataFrame,
    recomputed: DataFrame,
    results: DataFrame,
    candidates: Mapping[str, tuple[str, float]],
    frozen_problems: DataFrame,
    key: str = "experiment_id",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(metrics per candidate, chosen candidate, violations) at frozen thresholds.

    ``stored`` are the predictions frozen before labels were opened. Hash
    violations, drifted predictions and key mismatches are all reported.
    """
    columns = [c for c, _ in candidates.values()]
    rows, key_problems = score_join(stored, results, key)
    problems = union_all(
        [frozen_problems, prediction_drift(stored, recomputed, columns, key), key_problems]
    )
    limits = F.create_map(*[F.lit(v) for n, (_, t) in candidates.items() for v in (n, float(t))])
    stacked = stack_candidates(
        rows, {n: c for n, (c, _) in candidates.items()}, ["outcome", "actual"]
    ).withColumn("predicted", (F.col("score") >= limits[F.col("candidate")]).cast("int"))
    by = ["candidate", "listed"]
    metrics = (
        binary_metrics(stacked, "actual", "predicted", by)
        .join(probability_losses(stacked, "actual", "score", by), by)
        .join(subtype_metrics(stacked, "outcome", "predicted", by), by)
    )
    return metrics, select_candidate(metrics), problems
