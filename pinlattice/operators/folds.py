"""Family-grouped folds."""

from __future__ import annotations

import struct
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinlattice.operators.ordered import attach, ordered, with_scalars
from pinlattice.session import materialize


def family_folds(df: DataFrame, k: int, family: str = "family") -> DataFrame:
    """Rows with fold = (index of the sorted family) mod k + 1."""
    families = ordered(df.select(family).distinct(), [F.col(family)], position="__i")
    folds = families.select(family, ((F.col("__i") - 1) % k + 1).cast("int").alias("fold"))
    return attach(df, folds, [family])


_SLOTS = 4096  # places of one fold written out by one row
_ONE_BY_ONE = 512  # families of one size placed by plain comparison
_FEW_FAMILIES = 50_000  # a map of no more families is broadcast


def _score(load: tuple, size: tuple, goals: tuple, j: int) -> float:
    rows, failures = (load[0] + j * size[0]) / goals[0], (load[1] + j * size[1]) / goals[1]
    return rows * rows + failures * failures


def share_out(loads: Sequence[tuple], size: tuple, goals: tuple, n: int) -> list[int]:
    """How many of ``n`` families of one size (rows, failures) each fold takes.

    ``loads`` holds (rows, failures, families) per fold. The scores of a fold grow with
    each family it takes, so the greedy choice is a merge of rising sequences: all places
    below the n-th smallest score are taken, and of its ties the first by families and fold.
    """
    k = len(loads)
    if n <= _ONE_BY_ONE:
        taken = [0] * k
        for _ in range(n):
            best = min(
                range(k),
                key=lambda i: (_score(loads[i], size, goals, taken[i] + 1), loads[i][2] + taken[i] + 1, i),
            )
            taken[best] += 1
        return taken

    def below(limit: float, ties: bool) -> list[int]:
        found = []
        for load in loads:
            lo, hi = 0, n
            while lo < hi:
                middle = (lo + hi + 1) // 2
                score = _score(load, size, goals, middle)
                if score < limit or (ties and score == limit):
                    lo = middle
                else:
                    hi = middle - 1
            found.append(lo)
        return found

    # The bits of doubles that are not negative stand in the order of their values.
    low, high = 0, max(_bits(_score(load, size, goals, n)) for load in loads)
    while low < high:
        middle = (low + high) // 2
        if sum(below(_value(middle), True)) >= n:
            high = middle
        else:
            low = middle + 1
    taken, upto = below(_value(low), False), below(_value(low), True)
    ties = sorted((loads[i][2] + j, i) for i in range(k) for j in range(taken[i] + 1, upto[i] + 1))
    for _, i in ties[: n - sum(taken)]:
        taken[i] += 1
    return taken


def _bits(x: float) -> int:
    return struct.unpack("<q", struct.pack("<d", x))[0]


def _value(bits: int) -> float:
    return struct.unpack("<d", struct.pack("<q", bits))[0]


def balanced_fold_map(df: DataFrame, k: int, family: str = "family", actual: str = "actual") -> DataFrame:
    """(family, fold) of a greedy balance over rows and failures.

    Families in falling size go one by one to the fold with the smallest
    normalized squared load, then the fewest families, then the lowest number.
    Each choice depends on all before it, so one task reads the sizes in falling order
    and carries the loads of the folds; it sees a row per distinct size, not per family,
    and keeps none. The places that the folds take within a size are then numbered by
    score, and its families by name, each over many tasks, and meet by number.
    """
    size = ["__rows", "__failures"]
    counts = df.groupBy(family).agg(
        F.count(F.lit(1)).cast("double").alias("__rows"),
        F.coalesce(F.sum(F.col(actual).cast("double")), F.lit(0.0)).alias("__failures"),
    )
    goals = counts.agg(
        (F.sum("__rows") / k).alias("__goal_rows"),
        F.greatest(F.lit(1.0), F.sum("__failures") / k).alias("__goal_failures"),
    )
    sizes = with_scalars(counts.groupBy(*size).agg(F.count(F.lit(1)).alias("__n")), goals)

    def place(frames):
        loads = [(0.0, 0.0, 0)] * k
        for frame in frames:
            out = []
            for rows, failures, n, goal_rows, goal_failures in frame.itertuples(index=False):
                taken = share_out(loads, (rows, failures), (goal_rows, goal_failures), n)
                for i, (load, m) in enumerate(zip(loads, taken)):
                    if m:
                        out.append((rows, failures, i + 1, *load, m, goal_rows, goal_failures))
                loads = [(a + m * rows, b + m * failures, c + m) for (a, b, c), m in zip(loads, taken)]
            yield pd.DataFrame(out, columns=_TAKEN)

    falling = sizes.repartition(1).sortWithinPartitions(*[F.desc(c) for c in size])
    taken = falling.mapInPandas(place, ", ".join(f"{c} {t}" for c, t in zip(_TAKEN, _TAKEN_TYPES)))
    blocks = taken.withColumn(
        "__block", F.explode(F.sequence(F.lit(0), ((F.col("__taken") - 1) / _SLOTS).cast("bigint")))
    )
    slots = blocks.withColumn(
        "__j",
        F.explode(
            F.sequence(
                F.col("__block") * _SLOTS + 1, F.least(F.col("__taken"), (F.col("__block") + 1) * _SLOTS)
            )
        ),
    )
    rows = (F.col("__load_rows") + F.col("__j") * F.col("__rows")) / F.col("__goal_rows")
    failures = (F.col("__load_failures") + F.col("__j") * F.col("__failures")) / F.col("__goal_failures")
    slots = slots.select(
        *size,
        "fold",
        (rows * rows + failures * failures).alias("__score"),
        (F.col("__families") + F.col("__j")).alias("__order"),
    )
    slots = ordered(slots, [F.col("__score"), F.col("__order"), F.col("fold")], size, position="__place")
    families = ordered(counts, [F.col(family)], size, position="__place")
    keys = [*size, "__place"]
    return families.join(slots.select(*keys, "fold"), keys).select(family, "fold")


_TAKEN = [
    "__rows", "__failures", "fold", "__load_rows", "__load_failures", "__families", "__taken",
    "__goal_rows", "__goal_failures",
]
_TAKEN_TYPES = ["double", "double", "int", "double", "double", "bigint", "bigint", "double", "double"]


def balanced_folds(df: DataFrame, k: int, family: str = "family", actual: str = "actual") -> DataFrame:
    """Rows with their fold. A map of few families goes to the rows, which are read many times and then never moved for it."""
    folds = materialize(balanced_fold_map(df, k, family, actual))
    few = folds.limit(_FEW_FAMILIES + 1).count() <= _FEW_FAMILIES
    return attach(df, F.broadcast(folds) if few else folds, [family])


def fold_summary(folded: DataFrame, family: str = "family", actual: str = "actual") -> DataFrame:
    per_family = folded.groupBy("fold", family).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col(actual).cast("bigint")).alias("failures")
    )
    return per_family.groupBy("fold").agg(
        F.count(F.lit(1)).alias("families"),
        F.sum("rows").alias("rows"),
        F.sum("failures").alias("failures"),
    )


def fold_problems(folded: DataFrame, k: int, family: str = "family", actual: str = "actual") -> DataFrame:
    """Folds whose training rows would miss a class, or too few families for k folds."""
    per_fold = folded.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(actual).cast("bigint")).alias("p")
    )
    total = per_fold.agg(F.sum("n").alias("all_n"), F.sum("p").alias("all_p"), F.count(F.lit(1)).alias("folds"))
    joined = with_scalars(per_fold, total)
    train_p = F.col("all_p") - F.col("p")
    train_q = F.col("all_n") - F.col("all_p") - (F.col("n") - F.col("p"))
    return joined.filter((train_p == 0) | (train_q == 0) | (F.col("folds") < k)).select(
        F.lit("single_class_or_missing_fold").alias("rule"),
        F.col("fold").cast("string").alias("key"),
        F.concat_ws("/", train_p, train_q).alias("detail"),
    )
