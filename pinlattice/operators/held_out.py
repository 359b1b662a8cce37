"""Logistic models for every fold at once: each is trained on all rows but its own fold's.

Fitting one model after the other reads the table once per fold and step. Here one job per Newton
step serves all folds. Every row becomes one vector z that no fold changes: numbers with 0 for a
missing one, flags of missing numbers, one-hot levels of all rows, and 1. What a fold's own
preprocessing does (fill with its medians, standardize with its moments) is a linear map of z, so
a task forms the gradients and Hessians of all folds from z with matrix products, and each fold's
sums are carried over to its standardized space where its step is solved, in a group of its own.
The rows are packed once: a block of some thousand rows holds its folds, labels, numbers and levels as
byte strings that numpy reads as they are, so no value is converted between Spark and numpy in a step.

Medians over "all rows but one fold" come from one ordering of the distinct values and one of each
fold's own values: the number of jobs does not depend on the number of folds.

Levels that occur only in the fold left out have a zero column in its training rows, so their
weight stays 0, as if they were unknown. Ratings of rows without a fold are null.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pinlattice.constants import WEIGHTED_LOGISTIC_L2
from pinlattice.functions.vectors import sigmoid
from pinlattice.operators.ordered import attach, ordered
from pinlattice.operators.preprocess import _category, _numeric, long_numeric
from pinlattice.session import materialize, spread


def medians_without(df: DataFrame, numeric: Sequence[str], fold: str = "fold") -> DataFrame:
    """(fold, column, median): exact medians over all rows but the fold's, null where none are left.

    A fold's rank r among the other rows is rank r + o among all rows, where o counts the fold's own
    values below the answer. Both the own counts and the answers come from running counts.
    """
    folds = df.select(F.col(fold).alias("fold")).distinct()
    columns = F.array(*[F.lit(c) for c in numeric])
    wanted = folds.select("fold", F.explode(columns).alias("column"))
    own = (
        long_numeric(df.withColumn("__fold", F.col(fold)), numeric, ("__fold",))
        .filter(F.col("value").isNotNull())
        .groupBy(F.col("__fold").alias("fold"), "column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    own = materialize(own)
    values = own.groupBy("column", "value").agg(F.sum("n").alias("n"))
    values = materialize(ordered(values, [F.col("value")], ["column"], position=None, totals={"upto": "n"}))
    mine = ordered(own, [F.col("value")], ["fold", "column"], position=None, totals={"own": "n"})
    mine = mine.join(values.select("column", "value", "upto"), ["column", "value"])
    all_n = values.groupBy("column").agg(F.sum("n").alias("all_n"))
    fold_n = own.groupBy("fold", "column").agg(F.sum("n").alias("fold_n"))
    left = attach(wanted.join(all_n, "column", "left"), fold_n, ["fold", "column"], "left")
    left = left.select("fold", "column", (F.coalesce("all_n", F.lit(0)) - F.coalesce("fold_n", F.lit(0))).alias("n"))
    ranks = materialize(left.select("fold", "column", "n", F.floor((F.col("n") - 1) / 2).alias("lo"), F.ceil((F.col("n") - 1) / 2).alias("hi")))
    below = F.col("upto") - F.col("own")
    met = attach(mine, ranks, ["fold", "column"])
    shifts = met.groupBy("fold", "column").agg(*[F.max(F.when(below <= F.col(r), F.col("own"))).alias(f"o_{r}") for r in ("lo", "hi")])
    asked = attach(ranks.filter("n > 0"), shifts, ["fold", "column"], "left")
    asked = asked.select(
        "fold", "column", F.explode(F.array(*[F.struct(F.lit(r).alias("side"), (F.col(r) + F.coalesce(f"o_{r}", F.lit(0))).alias("mark")) for r in ("lo", "hi")])).alias("x")
    ).select("fold", "column", "x.side", "x.mark")
    # The value at a rank is the last one that starts at or before it: its number is a running count.
    marks = values.select(F.lit(None).cast(dict(asked.dtypes)["fold"]).alias("fold"), "column", F.lit("").alias("side"), (F.col("upto") - F.col("n")).alias("mark"), F.lit(1).alias("is_value"), "value")
    marks = marks.unionByName(asked.select("*", F.lit(0).alias("is_value"), F.lit(None).cast("double").alias("value")))
    numbered = ordered(marks, [F.col("mark"), F.col("is_value").desc(), F.col("fold"), F.col("side")], ["column"], position=None, totals={"at": "is_value"})
    known = numbered.filter("is_value = 1").select("column", "at", F.col("value").alias("found"))
    answers = numbered.filter("is_value = 0").select("fold", "column", "at").join(known, ["column", "at"])
    medians = answers.groupBy("fold", "column").agg(F.avg("found").alias("median"))
    return attach(wanted, medians, ["fold", "column"], "left")


@dataclass(frozen=True)
class Design:
    """The common vector z of a row: numbers, missing flags, levels, 1."""

    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    levels: tuple[tuple[str, str], ...]

    @property
    def width(self) -> int:
        return 2 * len(self.numeric) + len(self.levels) + 1

    def columns(self, df: DataFrame) -> list[Column]:
        """Numbers (null: missing) and the position of each category's level (null: unknown)."""
        at: dict[str, list[Column]] = {c: [] for c in self.categorical}
        for i, (c, level) in enumerate(self.levels):
            at[c] += [F.lit(level), F.lit(i)]
        out = [_numeric(df, c).alias(f"n{i}") for i, c in enumerate(self.numeric)]
        for i, c in enumerate(self.categorical):
            known = F.create_map(*at[c]) if at[c] else F.lit(None).cast("map<string,int>")
            out.append(F.try_element_at(known, _category(c)).cast("int").alias(f"c{i}"))
        return out

    def matrix(self, numbers: np.ndarray, levels: np.ndarray) -> np.ndarray:
        """z of the rows of a block, a line per component; ``numbers`` (NaN: missing) and ``levels`` (-1: unknown) have a line per column."""
        p = len(self.numeric)
        z = np.zeros((self.width, levels.shape[1]))
        missing = np.isnan(numbers)
        z[:p] = np.where(missing, 0.0, numbers)
        z[p : 2 * p] = missing
        for level in levels:
            rows = np.flatnonzero(level >= 0)
            z[2 * p + level[rows], rows] = 1.0
        z[-1] = 1.0
        return z

    def product(self, df: DataFrame, weights: Column) -> Column:
        """The product of the same vector with ``weights``, an array of its width; only what is not 0 is added."""
        p = len(self.numeric)
        total = F.lit(0.0)
        for i, c in enumerate(self.numeric):
            x = _numeric(df, c)
            total = total + F.when(x.isNull(), F.get(weights, F.lit(p + i))).otherwise(x * F.get(weights, F.lit(i)))
        for level in self.columns(df)[p:]:
            total = total + F.when(level.isNotNull(), F.get(weights, level + 2 * p)).otherwise(0.0)
        return total + F.get(weights, F.lit(self.width - 1))

    def transform_of(self, medians: np.ndarray, means: np.ndarray, scales: np.ndarray) -> np.ndarray:
        """T with features = z T: standardized filled numbers, levels, intercept."""
        p, n_levels = len(self.numeric), len(self.levels)
        t = np.zeros((self.width, p + n_levels + 1))
        for i in range(p):
            t[i, i] = 1.0 / scales[i]
            t[p + i, i] = medians[i] / scales[i]
            t[-1, i] = -means[i] / scales[i]
        t[2 * p : 2 * p + n_levels, p : p + n_levels] = np.eye(n_levels)
        t[-1, -1] = 1.0
        return t


def fit_design(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], max_levels: int = 10_000) -> Design:
    """Levels of all rows; a level is a column of every model, so their number has a checked limit."""
    found = []
    if categorical:
        pairs = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), _category(c).alias("level")) for i, c in enumerate(categorical)])).alias("x"))
        found = pairs.select("x.*").distinct().limit(max_levels + 1).collect()
        if len(found) > max_levels:
            raise ValueError(f"more than {max_levels} category levels")
    return Design(tuple(numeric), tuple(categorical), tuple((categorical[r["i"]], r["level"]) for r in sorted(found)))


def fold_scaling(df: DataFrame, numeric: Sequence[str], fold: str = "fold") -> dict[str, dict[str, tuple[float, float, float]]]:
    """fold -> column -> (median, mean, scale) of all rows but the fold's; one row per fold and column."""
    if not numeric:
        return {}
    values = long_numeric(df.withColumn("__fold", F.col(fold)), numeric, ("__fold",))
    centres = values.groupBy("column").agg(F.coalesce(F.avg("value"), F.lit(0.0)).alias("centre"))
    x = F.col("value") - F.col("centre")
    sums = (
        values.join(F.broadcast(centres), "column")
        .groupBy(F.col("__fold").alias("fold"), "column")
        .agg(F.first("centre").alias("centre"), F.count(F.lit(1)).alias("rows"), F.count("value").alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    )
    per_fold = attach(sums, medians_without(df, numeric, fold), ["fold", "column"]).collect()
    out: dict = {}
    for c in numeric:
        mine = [r for r in per_fold if r["column"] == c]
        total = [sum(r[k] or 0 for r in mine) for k in ("rows", "n", "s", "q")]
        for r in mine:
            rows, n, s, q = [t - (r[k] or 0) for t, k in zip(total, ("rows", "n", "s", "q"), strict=True)]
            median = 0.0 if r["median"] is None else float(r["median"])
            shift, missing = median - r["centre"], rows - n
            mean = (s + missing * shift) / rows if rows else 0.0
            variance = (q + missing * shift * shift) / rows - mean * mean if rows else 0.0
            scale = max(variance, 0.0) ** 0.5
            out.setdefault(r["fold"], {})[c] = (median, mean + r["centre"], scale if scale > 1e-12 else 1.0)
    return out


@dataclass(frozen=True)
class HeldOutModels:
    """One weight vector over z per fold."""

    design: Design
    weights: dict[object, tuple[float, ...]]
    rounds: int

    def score(self, df: DataFrame, fold: str = "fold", output: str = "probability") -> DataFrame:
        """Every row scored by the model of its fold; one row of weights per fold is joined."""
        kind = df.select(fold).dtypes[0][1]
        table = df.sparkSession.createDataFrame([(f, list(w)) for f, w in self.weights.items()], f"fold {kind}, weights array<double>")
        table = table.withColumnsRenamed({"fold": "__fold", "weights": "__weights"})
        # The driver holds these rows anyway; without the hint all rows of a fold would meet in one task.
        scored = df.join(F.broadcast(table), df[fold] == table["__fold"], "left")
        p = sigmoid(self.design.product(df, F.col("__weights")))
        return scored.withColumn(output, F.when(F.col("__weights").isNotNull(), p)).drop("__fold", "__weights")


_BLOCK = "folds binary, y binary, numbers binary, levels binary"


def _packed(df: DataFrame, folds: dict, fold: str, label: str, design: Design) -> DataFrame:
    """Blocks of the rows with a fold: a block is one batch, its numbers and levels have columns in front."""
    names, p = _BLOCK.replace(" binary", "").split(", "), len(design.numeric)
    place = F.create_map(*[x for f, i in folds.items() for x in (F.lit(f), F.lit(i))])
    rows = df.filter(F.col(fold).isNotNull()).select(F.try_element_at(place, F.col(fold)).alias("f"), F.col(label).cast("double").alias("y"), *design.columns(df))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, y, *rest = (batch.column(i) for i in range(batch.num_columns))
                numbers = [c.to_numpy(zero_copy_only=False).astype(float) for c in rest[:p]]
                levels = [c.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32) for c in rest[p:]]
                parts = [own.to_numpy().astype(np.int32), y.to_numpy().astype(float), np.array(numbers), np.array(levels, np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], names=names)

    return spread(rows.mapInArrow(run, _BLOCK))


def _blocks(batches: Iterator[pa.RecordBatch], design: Design) -> Iterator[tuple[np.ndarray, ...]]:
    """(folds, labels, z) of every block."""
    for batch in batches:
        for own, y, numbers, levels in zip(*[batch.column(i) for i in range(4)], strict=True):
            own = np.frombuffer(own.as_buffer(), np.int32)
            numbers = np.frombuffer(numbers.as_buffer()).reshape(len(design.numeric), len(own))
            levels = np.frombuffer(levels.as_buffer(), np.int32).reshape(len(design.categorical), len(own))
            yield own, np.frombuffer(y.as_buffer()), design.matrix(numbers, levels)


def _step(payloads: Sequence[bytes], beta: np.ndarray, t: np.ndarray, l2: float) -> tuple[np.ndarray, float, float]:
    """(Newton step, loss, largest gradient) of one fold from the sums over z of all tasks."""
    sums = np.sum([np.frombuffer(x) for x in payloads], axis=0)
    width = len(t)
    loss, gradient, hessian = sums[0], sums[1 : 1 + width], sums[1 + width :].reshape(width, width)
    penalty = np.full(len(beta), l2)
    penalty[-1] = 0.0
    g = t.T @ gradient + penalty * beta
    h = t.T @ hessian @ t + np.diag(np.maximum(penalty, 1e-12))
    return np.linalg.solve(h, g), float(loss + 0.5 * l2 * (beta[:-1] @ beta[:-1])), float(np.abs(g).max())


def fit_held_out(
    df: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    label: str = "actual",
    fold: str = "fold",
    l2: float = WEIGHTED_LOGISTIC_L2,
    weighted: bool = True,
    tolerance: float = 1e-7,
    max_rounds: int = 60,
) -> HeldOutModels:
    """Models of all folds by joint Newton steps; one job per step whatever the number of folds.

    A step that does not lower a fold's loss is halved for that fold. Tasks hold folds x width ** 2
    sums. Raises for a fold whose training rows miss a class.
    """
    design = fit_design(df, numeric, categorical)
    counts = df.groupBy(F.col(fold).alias("fold")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("p")).dropna(subset=["fold"]).collect()
    names = sorted(r["fold"] for r in counts)
    n_all, p_all = sum(r["n"] for r in counts), sum(r["p"] for r in counts)
    n = {r["fold"]: n_all - r["n"] for r in counts}
    p = {r["fold"]: p_all - r["p"] for r in counts}
    poor = [f for f in names if p[f] == 0 or p[f] == n[f]]
    if poor:
        raise ValueError(f"training rows of folds {poor[:5]} miss a class")
    scaling = fold_scaling(df.filter(F.col(fold).isNotNull()), numeric, fold)
    maps = []
    for f in names:
        parts = [scaling[f][c] for c in numeric]
        maps.append(design.transform_of(*[np.array([x[k] for x in parts]) for k in range(3)]))
    pos = np.array([n[f] / (2.0 * p[f]) if weighted else 1.0 for f in names])
    neg = np.array([n[f] / (2.0 * (n[f] - p[f])) if weighted else 1.0 for f in names])
    index = {f: i for i, f in enumerate(names)}
    width, folds = design.width, len(names)
    source = _packed(df, index, fold, label, design)
    betas = [np.zeros(t.shape[1]) for t in maps]

    def totals(weights: np.ndarray, active: np.ndarray) -> DataFrame:
        """Rows (i, payload): loss, gradient and Hessian over z per active fold and task."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((folds, 1 + width + width * width))
            for own, y, z in _blocks(batches, design):
                eta = weights @ z
                q = 1.0 / (1.0 + np.exp(-eta))
                w = np.where(y > 0, pos[:, None], neg[:, None])
                w[own, np.arange(len(own))] = 0.0
                # log(1 + exp(eta)) - y eta, without overflow.
                sums[:, 0] += (w * (np.maximum(eta, 0.0) + np.log1p(np.exp(-np.abs(eta))) - y * eta)).sum(1)
                sums[:, 1 : 1 + width] += (w * (q - y)) @ z.T
                curve = w * q * (1.0 - q)
                for i in np.flatnonzero(active):
                    sums[i, 1 + width :] += ((curve[i] * z) @ z.T).reshape(-1)
            at = np.flatnonzero(active)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array([sums[i].tobytes() for i in at], pa.binary())], names=["i", "payload"])

        return source.mapInArrow(run, "i int, payload binary")

    def solve(current: list[np.ndarray], active: np.ndarray) -> dict[int, tuple]:
        weights = np.stack([t @ b for t, b in zip(maps, current, strict=True)])

        def one(table: pa.Table) -> pa.Table:
            i = table.column("i")[0].as_py()
            step, loss, slope = _step([x.as_py() for x in table.column("payload")], current[i], maps[i], l2)
            return pa.table([pa.array([i], pa.int32()), pa.array([step.tolist()], pa.list_(pa.float64())), pa.array([loss]), pa.array([slope])], names=["i", "step", "loss", "slope"])

        # One row per fold comes back.
        found = totals(weights, active).groupBy("i").applyInArrow(one, "i int, step array<double>, loss double, slope double").collect()
        return {r["i"]: (np.array(r["step"]), r["loss"], r["slope"]) for r in found}

    active = np.ones(folds, bool)
    best: list[tuple | None] = [None] * folds
    rounds = 0
    trial = list(betas)
    shrink = np.ones(folds)
    while active.any() and rounds < max_rounds:
        rounds += 1
        for i, (step, loss, slope) in solve(trial, active).items():
            if best[i] is not None and loss > best[i][2] + 1e-9 * abs(best[i][2]) and shrink[i] > 1e-6:
                shrink[i] /= 2
            else:
                best[i], shrink[i] = (trial[i], step, loss), 1.0
                active[i] = slope > tolerance * max(1.0, n[names[i]])  # summed, not mean, gradient
            trial[i] = best[i][0] - shrink[i] * best[i][1]
        # The last accepted point takes its full step, already computed, when it is done.
    final = {f: tuple((maps[i] @ trial[i]).tolist()) for f, i in index.items()}
    return HeldOutModels(design, final, rounds)
