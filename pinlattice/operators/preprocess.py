"""Feature preprocessing fitted by aggregation and applied as column expressions.

A fitted object is a handful of driver-side parameters per feature column
(medians, means, scales, level sets, cut points), never rows.
"""

from __future__ import annotations

import operator
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pinlattice.constants import MAXIMUM_BINS
from pinlattice.operators.ordered import exact_quantiles

MISSING = "<missing>"


def _numeric(df: DataFrame, name: str) -> Column:
    """Booleans become 1/0 and text a number; NaN counts as missing."""
    value = F.col(name)
    kind = df.schema[name].dataType.typeName()
    if kind == "string":
        number = (
            F.when(F.lower(value) == "true", 1.0)
            .when(F.lower(value) == "false", 0.0)
            .otherwise(value.try_cast("double"))
        )
    else:
        number = value.cast("double")
    return F.nanvl(number, F.lit(None).cast("double"))


def _category(name: str) -> Column:
    return F.coalesce(F.nullif(F.col(name).cast("string"), F.lit("")), F.lit(MISSING))


@dataclass(frozen=True)
class Preprocessor:
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    medians: dict[str, float]
    means: dict[str, float]
    scales: dict[str, float]
    levels: dict[str, tuple[str, ...]]

    @property
    def width(self) -> int:
        return len(self.numeric) + sum(len(v) for v in self.levels.values())

    @property
    def names(self) -> list[str]:
        return [f"numeric::{c}" for c in self.numeric] + [
            f"category::{c}=={level}" for c in self.categorical for level in self.levels[c]
        ]

    def features(self, df: DataFrame) -> Column:
        """array<double>: filled and standardized numbers, then one-hot levels (unknown: zeros)."""
        parts = [
            (F.coalesce(_numeric(df, c), F.lit(self.medians[c])) - self.means[c]) / self.scales[c]
            for c in self.numeric
        ]
        for c in self.categorical:
            parts += [(_category(c) == level).cast("double") for level in self.levels[c]]
        return F.array(*parts)

    def transform(self, df: DataFrame, output: str = "features") -> DataFrame:
        return df.withColumn(output, self.features(df))


def fit_preprocessor(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], max_levels: int = 10_000
) -> Preprocessor:
    """Exact medians, then means and population deviations after the fill, and level sets.

    The level sets become model columns, so more than ``max_levels`` of them is
    an error instead of an unbounded collection.
    """
    numeric, categorical = tuple(numeric), tuple(categorical)
    medians = column_medians(df, numeric)
    aggregates = []
    for c in numeric:
        filled = F.coalesce(_numeric(df, c), F.lit(medians[c]))
        aggregates += [F.avg(filled).alias(f"mean::{c}"), F.stddev_pop(filled).alias(f"std::{c}")]
    row = df.agg(*aggregates).first().asDict() if aggregates else {}
    scales = {c: float(row[f"std::{c}"] or 0.0) for c in numeric}
    levels: dict[str, list[str]] = {c: [] for c in categorical}
    if categorical:
        pairs = (
            df.select(
                F.explode(
                    F.array(
                        *[
                            F.struct(F.lit(c).alias("column"), _category(c).alias("level"))
                            for c in categorical
                        ]
                    )
                ).alias("x")
            )
            .select("x.*")
            .distinct()
        )
        found = pairs.limit(max_levels + 1).collect()
        if len(found) > max_levels:
            raise ValueError(f"more than {max_levels} category levels")
        for item in sorted(found):
            levels[item["column"]].append(item["level"])
    return Preprocessor(
        numeric,
        categorical,
        medians,
        {c: float(row[f"mean::{c}"] or 0.0) for c in numeric},
        {c: s if s > 1e-12 else 1.0 for c, s in scales.items()},
        {c: tuple(v) for c, v in levels.items()},
    )


def long_numeric(df: DataFrame, numeric: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(column, value) rows of numeric columns, with the kept columns in front."""
    return df.select(
        *keep,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column"), _numeric(df, c).alias("value"))
                    for c in numeric
                ]
            )
        ).alias("x"),
    ).select(*keep, "x.*")


def column_medians(df: DataFrame, numeric: Sequence[str]) -> dict[str, float]:
    """Exact median per numeric column, 0 for a column without values."""
    if not numeric:
        return {}
    table = exact_quantiles(long_numeric(df, numeric), "value", {"median": 0.5}, ["column"])
    found = {r["column"]: float(r["median"]) for r in table.collect()}
    return {c: found.get(c, 0.0) for c in numeric}


def preprocessor_table(df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """The numeric part of a fitted preprocessor as a table (column, median, mean, scale)."""
    values = long_numeric(df, numeric)
    medians = exact_quantiles(values, "value", {"median": 0.5}, ["column"])
    # One row per column: without the hint all values of a column would meet in one task.
    filled = values.join(F.broadcast(medians), "column").withColumn(
        "value", F.coalesce("value", "median")
    )
    stats = filled.groupBy("column").agg(
        F.first("median").alias("median"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("deviation"),
    )
    return stats.select(
        "column",
        "median",
        "mean",
        F.when(F.col("deviation") > 1e-12, F.col("deviation")).otherwise(1.0).alias("scale"),
    )


def unknown_categories(df: DataFrame, levels: dict[str, Sequence[str]]) -> DataFrame:
    """(column, level) rows that a fitted level set does not know."""
    parts = F.array(
        *[
            F.when(~_category(c).isin(*known), F.struct(F.lit(c).alias("column"), _category(c).alias("level")))
            for c, known in levels.items()
        ]
    )
    return df.select(F.explode(F.array_compact(parts)).alias("x")).select("x.*").distinct()


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): n / (2 * n_class); needs both classes."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("__total"))
    return counts.join(F.broadcast(total)).select(
        label, "n", (F.col("__total") / (2.0 * F.col("n"))).alias("weight")
    )


def root_weights(df: DataFrame, label: str, classes: int) -> DataFrame:
    """(label, n, weight): square root of the inverse frequency, scaled to mean 1."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("__total"))
    raw = counts.join(F.broadcast(total)).withColumn(
        "__raw", F.sqrt(F.col("__total") / (classes * F.col("n")))
    )
    mean = raw.agg(F.avg("__raw").alias("__mean"))
    return raw.join(F.broadcast(mean)).select(
        label, "n", (F.col("__raw") / F.col("__mean")).alias("weight")
    )


@dataclass(frozen=True)
class VectorScaler:
    means: tuple[float, ...]
    scales: tuple[float, ...]

    def scaled(self, vector: Column) -> Column:
        means = F.array(*[F.lit(m) for m in self.means])
        scales = F.array(*[F.lit(s) for s in self.scales])
        centred = F.zip_with(vector, means, lambda x, m: x - m)
        return F.zip_with(centred, scales, lambda x, s: x / s)


def vector_moments(df: DataFrame, vector: str) -> DataFrame:
    """(dimension, mean, deviation) with population deviations, tree-combined per partition."""
    rows = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    stats = rows.agg(
        Summarizer.metrics("count", "mean", "variance").summary(F.col("v")).alias("s")
    )
    from pyspark.ml.functions import vector_to_array

    n = F.col("s.count").cast("double")
    flat = stats.select(
        n.alias("n"),
        F.arrays_zip(
            vector_to_array("s.mean").alias("mean"), vector_to_array("s.variance").alias("variance")
        ).alias("z"),
    )
    return flat.select("n", F.posexplode("z").alias("dimension", "x")).select(
        "dimension",
        F.col("x.mean").alias("mean"),
        F.sqrt(F.col("x.variance") * (F.col("n") - 1) / F.col("n")).alias("deviation"),
    )


def fit_vector_scaler(df: DataFrame, vector: str) -> VectorScaler:
    rows = vector_moments(df, vector).orderBy("dimension").collect()
    return VectorScaler(
        tuple(r["mean"] for r in rows),
        tuple(r["deviation"] if r["deviation"] > 1e-12 else 1.0 for r in rows),
    )


def fit_bins(df: DataFrame, vector: str, bins: int = MAXIMUM_BINS) -> list[list[float]]:
    """Interior cut points per vector position: distinct linear quantiles strictly inside the range."""
    table = bin_cuts(df.select(F.posexplode(vector).alias("column", "value")), bins)
    found = {r["column"]: list(r["cuts"]) for r in table.collect()}
    width = df.select(F.size(vector).alias("n")).agg(F.max("n")).first()[0]
    return [found.get(i, []) for i in range(width)]


def bin_cuts(values: DataFrame, bins: int = MAXIMUM_BINS) -> DataFrame:
    """(column, cuts) of (column, value) rows."""
    names = {f"q{i}": i / bins for i in range(1, bins)}
    table = exact_quantiles(values, "value", {**names, "lo": 0.0, "hi": 1.0}, ["column"])
    cuts = F.array_sort(F.array_distinct(F.array(*[F.col(n) for n in names])))
    return table.select(
        "column",
        F.filter(cuts, lambda c: (c > F.col("lo")) & (c < F.col("hi"))).alias("cuts"),
    )


# Comparisons of a row that are written out; more of them would not be compiled.
_WRITTEN_OUT = 400


def bin_values(vector: Column, cuts: Sequence[Sequence[float]]) -> Column:
    """array<int>: number of cuts that are not above the value, per position."""
    table = F.array(
        *[
            F.array(*[F.lit(float(c)) for c in column]) if column else F.array().cast("array<double>")
            for column in cuts
        ]
    )
    any_length = F.zip_with(vector, table, lambda x, cs: F.size(F.filter(cs, lambda c: c <= x)))
    if not cuts or sum(map(len, cuts)) > _WRITTEN_OUT:
        return any_length
    counted = []
    for i, column in enumerate(cuts):
        value = F.get(vector, F.lit(i))
        counted.append(reduce(operator.add, [F.when(value >= float(c), 1).otherwise(0) for c in column], F.lit(0)))
    return F.when(F.size(vector) == len(cuts), F.array(*counted)).otherwise(any_length)
