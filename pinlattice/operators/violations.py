"""Rule checks return rows (rule, key, detail); strict callers raise on them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pinlattice.constants import PREVIEW_LIMIT


class ContractError(ValueError):
    """Raised when data breaks a rule that has to hold."""


def violation(df: DataFrame, rule: str, key: Column, detail: Column | None = None) -> DataFrame:
    return df.select(
        F.lit(rule).alias("rule"),
        key.cast("string").alias("key"),
        (F.lit("") if detail is None else detail.cast("string")).alias("detail"),
    )


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    frames = list(frames)
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


def broken_rules(rules: Mapping[str, Column]) -> Column:
    """array<string> of the rules whose condition is true; a null condition is not broken."""
    return F.array_compact(
        F.array(*[F.when(condition, F.lit(rule)) for rule, condition in rules.items()])
    )


def explode_rules(df: DataFrame, key: Column, rules: Mapping[str, Column]) -> DataFrame:
    """One row per broken rule, found in one pass over the table."""
    return df.select(
        F.explode(broken_rules(rules)).alias("rule"),
        key.cast("string").alias("key"),
        F.lit("").alias("detail"),
    )


def require_empty(violations: DataFrame, what: str) -> None:
    first = violations.limit(5).collect()
    if first:
        raise ContractError(f"{what}: {[tuple(r) for r in first]}")


def id_preview(df: DataFrame, kind: str, key: str, limit: int = PREVIEW_LIMIT) -> DataFrame:
    """First ``limit`` sorted keys per kind.

    The row-number filter is turned into a partial per-task limit before the
    shuffle, so a hot kind sends at most ``limit`` rows per task.
    """
    window = W.partitionBy(kind).orderBy(key)
    return (
        df.withColumn("__rn", F.row_number().over(window))
        .filter(F.col("__rn") <= limit)
        .groupBy(kind)
        .agg(F.array_sort(F.collect_list(key)).alias("preview"))
    )
