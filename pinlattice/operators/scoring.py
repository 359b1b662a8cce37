"""Scoring with frozen models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinlattice.constants import POST_INSTALL_THRESHOLD
from pinlattice.functions.vectors import noisy_or
from pinlattice.operators.boosting import BoostedHead, tree_probabilities
from pinlattice.operators.models import HybridFeatures, LinearModel


def score_linear(df: DataFrame, model: LinearModel, features: str = "features") -> DataFrame:
    scored = df.withColumn("structured_probability", model.probability(F.col(features)))
    return scored.withColumn(
        "predicted_failure", F.col("structured_probability") >= model.threshold
    )


def score_post_install(
    df: DataFrame,
    embeddings: DataFrame,
    features: HybridFeatures,
    cuts: list[list[float]],
    import_head: BoostedHead,
    smoke_head: BoostedHead,
    threshold: float = POST_INSTALL_THRESHOLD,
) -> DataFrame:
    """Import, smoke and combined probability; null when a release has no vector.

    Rows without both vectors skip the tree scoring.
    """
    ready = features.transform(df, embeddings, how="left")
    complete = F.coalesce(F.forall("features", lambda x: x.isNotNull()), F.lit(False))
    heads = {"import": import_head, "smoke": smoke_head}
    none = F.lit(None).cast("double")
    scored = (
        ready.filter(complete)
        .withColumn("__p", tree_probabilities(heads, F.col("features"), cuts))
        .select(
            *df.columns,
            F.col("__p.import").alias("import_probability"),
            F.col("__p.smoke").alias("smoke_probability"),
        )
        .unionByName(
            ready.filter(~complete).select(
                *df.columns, none.alias("import_probability"), none.alias("smoke_probability")
            )
        )
    )
    return post_install_decision(scored, threshold)


def post_install_decision(df: DataFrame, threshold: float = POST_INSTALL_THRESHOLD) -> DataFrame:
    """combined_probability, risk_detected and the likely stage from the two stage probabilities."""
    i, s = F.col("import_probability"), F.col("smoke_probability")
    scored = df.withColumn("combined_probability", noisy_or(i, s))
    risky = F.col("combined_probability") >= threshold
    return scored.select(
        "*",
        risky.alias("risk_detected"),
        (risky & (i >= s)).alias("predicted_import_failure"),
        (risky & (s > i)).alias("predicted_smoke_failure"),
        F.when(i >= s, "import").when(s > i, "smoke test").alias("likely_stage"),
    )


def score_hybrid(
    df: DataFrame,
    structured: str,
    resolution: str,
    post: str,
    structured_threshold: float,
    post_threshold: float,
) -> DataFrame:
    """Warn when either model does; risk is the larger probability."""
    s, r, p = F.col(structured), F.col(resolution), F.col(post)
    return df.select(
        "*",
        F.greatest(s, p).alias("risk_score"),
        ((s >= structured_threshold) | (p >= post_threshold)).alias("predicted_failure"),
        F.when(p >= r, "post-install/import").otherwise("dependency resolution").alias("likely_stage"),
    )


def pair_risk(df: DataFrame) -> DataFrame:
    """Evidence type, risk and stage of scored pairs.

    Needs constraints_allow, structured_probability and the post-install columns
    (null where the pair was not scored).
    """
    allowed, combined = F.col("constraints_allow"), F.col("combined_probability")
    scored = combined.isNotNull()
    risky = F.coalesce(F.col("risk_detected"), F.lit(False))
    return df.select(
        *[c for c in df.columns if c not in ("risk_detected", "likely_stage")],
        F.when(~allowed, "published_constraint_conflict")
        .when(scored, "post_install_prediction")
        .otherwise("structured_ranking_signal")
        .alias("evidence_type"),
        F.when(~allowed, F.lit(1.0))
        .when(scored, combined)
        .otherwise(F.col("structured_probability"))
        .alias("risk_score"),
        F.when(~allowed, "dependency resolution")
        .when(~scored, "not assessed")
        .when(F.col("import_probability") >= F.col("smoke_probability"), "import")
        .otherwise("smoke test")
        .alias("likely_stage"),
        (~allowed | risky).alias("risk_detected"),
        F.when(scored, "covered").otherwise("not_scored").alias("model_coverage"),
        risky.alias("predicted_failure"),
    )
