"""Training, out-of-fold evaluation and comparison of failure-risk models."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pinlattice.constants import LOGISTIC_L2, PROJECTION_WIDTH, WEIGHTED_LOGISTIC_L2
from pinlattice.functions.names import canonical_name
from pinlattice.functions.vectors import dot, noisy_or, pair_interactions, sigmoid
from pinlattice.operators.held_out import fit_held_out
from pinlattice.operators.metrics import (
    binary_metrics,
    probability_losses,
    select_threshold,
    subtype_metrics,
)
from pinlattice.operators.ordered import attach_by
from pinlattice.operators.preprocess import Preprocessor, VectorScaler, fit_vector_scaler, vector_moments
from pinlattice.operators.violations import union_all, violation
from pinlattice.session import materialize


@dataclass(frozen=True)
class LinearModel:
    """Frozen logistic weights: a driver-side parameter vector, scored as an expression."""

    weights: tuple[float, ...]
    intercept: float
    threshold: float = 0.5

    def probability(self, features: Column) -> Column:
        weights = F.array(*[F.lit(w) for w in self.weights])
        return sigmoid(F.lit(self.intercept) + dot(features, weights))

    def payload(self) -> dict:
        return {
            "weights": list(self.weights),
            "intercept": self.intercept,
            "threshold": self.threshold,
        }


def _fit_logistic(df: DataFrame, features: str, label: str, reg: float, weight: str | None) -> LinearModel:
    columns = [array_to_vector(F.col(features)).alias("x"), F.col(label).cast("double").alias("y")]
    if weight:
        columns.append(F.col(weight).alias("w"))
    estimator = LogisticRegression(
        featuresCol="x",
        labelCol="y",
        regParam=reg,
        elasticNetParam=0.0,
        standardization=False,
        maxIter=200,
        tol=1e-9,
        **({"weightCol": "w"} if weight else {}),
    )
    model = estimator.fit(df.select(*columns))
    return LinearModel(tuple(float(c) for c in model.coefficients), float(model.intercept))


def fit_logistic(df: DataFrame, features: str = "features", label: str = "label", l2: float = LOGISTIC_L2) -> LinearModel:
    """L2 logistic regression; the penalty is l2 / rows as in the mean-loss form."""
    return _fit_logistic(df, features, label, l2 / df.count(), None)


def fit_weighted_logistic(
    df: DataFrame, features: str = "features", label: str = "label", l2: float = WEIGHTED_LOGISTIC_L2
) -> LinearModel:
    """Class-balanced form; the weights sum to the number of rows."""
    counts = df.agg(F.sum(F.col(label).cast("bigint")), F.count(F.lit(1))).first()
    p, n = int(counts[0] or 0), int(counts[1])
    if p == 0 or p == n:
        raise ValueError("weighted logistic regression needs both classes")
    weight = F.when(F.col(label) == 1, n / (2.0 * p)).otherwise(n / (2.0 * (n - p)))
    return _fit_logistic(df.withColumn("__w", weight), features, label, l2 / n, "__w")


@dataclass(frozen=True)
class Projection:
    mean: tuple[float, ...]
    components: tuple[tuple[float, ...], ...]

    def project(self, vector: Column) -> Column:
        mean = F.array(*[F.lit(m) for m in self.mean])
        centred = F.zip_with(vector.cast("array<double>"), mean, lambda x, m: x - m)
        return F.array(*[dot(centred, F.array(*[F.lit(v) for v in c])) for c in self.components])


def fit_projection(
    embeddings: DataFrame, keys: DataFrame, width: int = PROJECTION_WIDTH, vector: str = "embedding"
) -> Projection:
    """Principal axes of the distinct training releases (package, version).

    Raises when a training release has no vector. Spark's PCA centres while
    fitting but not while transforming, so the mean is kept and subtracted here.
    """
    wanted = keys.select("package", "version").distinct()
    missing = wanted.join(embeddings, ["package", "version"], "left_anti").limit(5).collect()
    if missing:
        raise ValueError(f"missing release embeddings: {[tuple(r) for r in missing]}")
    rows = embeddings.join(wanted, ["package", "version"], "left_semi").select(
        array_to_vector(F.col(vector).cast("array<double>")).alias("v")
    )
    moments = vector_moments(rows.select(vector_to_array("v").alias("v")), "v")
    mean = [r["mean"] for r in moments.orderBy("dimension").collect()]
    count = min(width, len(mean), rows.count())
    axes = PCA(k=count, inputCol="v", outputCol="p").fit(rows).pc.toArray()
    return Projection(
        tuple(float(m) for m in mean), tuple(tuple(map(float, axes[:, i])) for i in range(count))
    )


def join_embeddings(
    frame: DataFrame, embeddings: DataFrame, vector: str = "embedding", how: str = "inner"
) -> DataFrame:
    """Vectors of both sides as ``vector_a`` and ``vector_b``."""
    for side in ("a", "b"):
        lookup = embeddings.select(
            canonical_name(F.col("package")).alias("__name"),
            F.col("version").alias("__version"),
            F.col(vector).alias(f"vector_{side}"),
        )
        frame = frame.join(
            lookup,
            (canonical_name(F.col(f"package_{side}_name")) == F.col("__name"))
            & (F.col(f"package_{side}_version") == F.col("__version")),
            how,
        ).drop("__name", "__version")
    return frame


def missing_embeddings(frame: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Distinct releases of a feature frame without a vector."""
    sides = union_all(
        [
            frame.select(
                canonical_name(F.col(f"package_{s}_name")).alias("package"),
                F.col(f"package_{s}_version").alias("version"),
            )
            for s in ("a", "b")
        ]
    ).distinct()
    known = embeddings.select(canonical_name(F.col("package")).alias("package"), "version")
    return sides.join(known, ["package", "version"], "left_anti")


@dataclass(frozen=True)
class HybridFeatures:
    """Structured features next to scaled interactions of projected release vectors."""

    preprocessor: Preprocessor
    projection: Projection
    scaler: VectorScaler

    @property
    def width(self) -> int:
        return self.preprocessor.width + 4 * len(self.projection.components)

    def release_vectors(self, embeddings: DataFrame) -> DataFrame:
        """Project once per release, not once per pair."""
        return embeddings.select(
            "package", "version", self.projection.project(F.col("embedding")).alias("projected")
        )

    def transform(self, frame: DataFrame, embeddings: DataFrame, how: str = "inner") -> DataFrame:
        joined = join_embeddings(frame, self.release_vectors(embeddings), "projected", how)
        text = self.scaler.scaled(pair_interactions(F.col("vector_a"), F.col("vector_b")))
        return joined.withColumn(
            "features", F.concat(self.preprocessor.features(joined), text)
        ).drop("vector_a", "vector_b")


def fit_hybrid_features(
    train: DataFrame, embeddings: DataFrame, preprocessor: Preprocessor, width: int = PROJECTION_WIDTH
) -> HybridFeatures:
    """Projection and scaler fitted on the training rows only."""
    keys = union_all(
        [
            train.select(
                canonical_name(F.col(f"package_{s}_name")).alias("package"),
                F.col(f"package_{s}_version").alias("version"),
            )
            for s in ("a", "b")
        ]
    )
    projection = fit_projection(embeddings, keys, width)
    projected = embeddings.select(
        "package", "version", projection.project(F.col("embedding")).alias("projected")
    )
    joined = join_embeddings(train, projected, "projected")
    pairs = joined.select(pair_interactions(F.col("vector_a"), F.col("vector_b")).alias("x"))
    return HybridFeatures(preprocessor, projection, fit_vector_scaler(pairs, "x"))


Fit = Callable[[DataFrame], Callable[[DataFrame], DataFrame]]


def out_of_fold(
    df: DataFrame, fit: Fit, key: str = "experiment_id", fold: str = "fold"
) -> tuple[DataFrame, DataFrame]:
    """(scored rows, violations): every row is scored by a model that never saw its fold.

    ``fit`` maps training rows to a scoring function. The driver loops over
    folds (a small parameter), every fit and score is a Spark job. The scored
    rows are written per fold so later metrics do not refit.
    """
    folds = sorted(r[0] for r in df.select(fold).distinct().collect())
    parts = []
    for number in folds:
        score = fit(df.filter(F.col(fold) != number))
        parts.append(score(df.filter(F.col(fold) == number)))
    scored = materialize(union_all(parts))
    uncovered = df.select(key).join(
        scored.filter(F.col("probability").isNotNull()).select(key), key, "left_anti"
    )
    return scored, violation(uncovered, "no_out_of_fold_score", F.col(key))


def logistic_fit(numeric: Sequence[str], categorical: Sequence[str], label: str = "actual", weighted: bool = True) -> Fit:
    """A ``Fit`` that learns preprocessing and weights on the training rows of a fold."""
    from pinlattice.operators.preprocess import fit_preprocessor

    def fit(train: DataFrame):
        preprocessor = fit_preprocessor(train, numeric, categorical)
        rows = preprocessor.transform(train)
        trainer = fit_weighted_logistic if weighted else fit_logistic
        model = trainer(rows, label=label)
        return lambda df: df.withColumn("probability", model.probability(preprocessor.features(df)))

    return fit


def held_out_scores(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], key: str = "experiment_id", fold: str = "fold", label: str = "actual"
) -> tuple[DataFrame, DataFrame]:
    """(scored rows, violations): ``out_of_fold`` with weighted logistic models, all folds fitted together."""
    models = fit_held_out(df, numeric, categorical, label, fold)
    scored = models.score(df, fold)
    uncovered = scored.filter(F.col("probability").isNull())
    return scored, violation(uncovered, "no_out_of_fold_score", F.col(key))


def leave_one_family_out(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], family: str = "family", actual: str = "actual", key: str = "experiment_id"
) -> tuple[DataFrame, DataFrame]:
    """(metrics per held-out family next to the majority class of its training rows, violations)."""
    scored, problems = held_out_scores(df, numeric, categorical, key, family, actual)
    return family_metrics(scored, family, actual), problems


def family_metrics(scored: DataFrame, family: str = "family", actual: str = "actual") -> DataFrame:
    """Metrics of held-out rows per family; the majority class is that of all other families."""
    predicted = scored.withColumn("predicted", (F.col("probability") >= 0.5).cast("int"))
    metrics = binary_metrics(predicted, actual, "predicted", [family])
    per_family = scored.groupBy(family).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(actual).cast("bigint")).alias("p")
    )
    totals = per_family.agg(F.sum("n").alias("all_n"), F.sum("p").alias("all_p"))
    majority = attach_by(per_family, totals, ()).select(
        family,
        (
            (F.col("all_p") - F.col("p")) * 2 >= F.col("all_n") - F.col("n")
        ).alias("train_majority_fails"),
        (F.col("p") / F.col("n")).alias("failure_rate"),
    )
    return metrics.join(majority, family).withColumn(
        "majority_accuracy",
        F.when(F.col("train_majority_fails"), F.col("failure_rate")).otherwise(
            1 - F.col("failure_rate")
        ),
    )


def stack_candidates(df: DataFrame, candidates: Mapping[str, str], keep: Sequence[str]) -> DataFrame:
    """Wide score columns -> rows (candidate, listed, score), in one pass over the table."""
    return df.select(
        *keep,
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("candidate"),
                        F.lit(i).alias("listed"),
                        F.col(column).cast("double").alias("score"),
                    )
                    for i, (name, column) in enumerate(candidates.items())
                ]
            )
        ).alias("c"),
    ).select(*keep, "c.*")


def evaluate_candidates(
    df: DataFrame, candidates: Mapping[str, str], outcome: str = "outcome"
) -> DataFrame:
    """Threshold, rates, Brier score and subtype recalls per candidate score column."""
    rows = stack_candidates(df, candidates, [outcome]).withColumn(
        "actual", (F.col(outcome) != "pass").cast("int")
    )
    by = ["candidate", "listed"]
    chosen = select_threshold(rows, "score", "actual", by)
    decided = rows.join(chosen.select(*by, "threshold"), by).withColumn(
        "predicted", (F.col("score") >= F.col("threshold")).cast("int")
    )
    losses = probability_losses(rows, "actual", "score", by)
    subtypes = subtype_metrics(decided, outcome, "predicted", by)
    return chosen.join(losses, by).join(subtypes, by)


def apply_frozen_thresholds(df: DataFrame, candidates: Mapping[str, tuple[str, float]]) -> DataFrame:
    """Add ``predicted_<candidate>`` for frozen (score column, threshold) pairs."""
    return df.select(
        "*",
        *[
            (F.col(column) >= threshold).cast("int").alias(f"predicted_{name}")
            for name, (column, threshold) in candidates.items()
        ],
    )


def prediction_drift(
    stored: DataFrame, recomputed: DataFrame, columns: Sequence[str], key: str = "experiment_id", tolerance: float = 1e-9
) -> DataFrame:
    """Violations where a stored prediction differs from the recomputed one."""
    right = recomputed.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = stored.join(right, key, "full_outer")
    return union_all(
        [
            violation(
                joined.filter(
                    ~F.coalesce(F.abs(F.col(c) - F.col(f"__{c}")) <= tolerance, F.lit(False))
                ),
                f"prediction_differs_{c}",
                F.col(key),
            )
            for c in columns
        ]
    )


def compare_models(metrics: DataFrame, reference: str, values: Sequence[str]) -> DataFrame:
    """Differences of every candidate to a reference candidate."""
    base = metrics.filter(F.col("candidate") == reference).select(
        *[F.col(v).alias(f"__{v}") for v in values]
    )
    return attach_by(metrics.select("candidate", *values), base, ()).select(
        "candidate",
        *values,
        *[(F.col(v) - F.col(f"__{v}")).alias(f"{v}_change") for v in values],
    )


def combine_scores(left: DataFrame, right: DataFrame, key: str = "experiment_id") -> DataFrame:
    """Noisy-or of the ``probability`` columns of two score tables with the same keys."""
    return left.join(
        right.select(key, F.col("probability").alias("__other")), key
    ).withColumn("hybrid_probability", noisy_or(F.col("probability"), F.col("__other"))).withColumnRenamed(
        "__other", "other_probability"
    )
