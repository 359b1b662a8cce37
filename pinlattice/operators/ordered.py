"""Exact row numbers, running totals and quantiles without a single-task window.

A plain ``row_number`` or running ``sum`` sorts a whole group (or the whole
table) in one task. Here rows are range-partitioned by the group and the order,
so a group of any size is spread over many tasks; each partition is numbered on
its own and the partition offsets (one row per partition) are added afterwards.
The partitioned rows are written once, because two reads of a range partitioning
must see the same boundaries.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pinlattice.session import materialize

_ROW_BITS = 33


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on null-safe keys and keep one copy of them."""
    renamed = right.select(
        *[F.col(k).alias(f"__{k}") for k in keys],
        *[F.col(c) for c in right.columns if c not in keys],
    )
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(renamed[f"__{key}"])
    return left.join(renamed, condition, how).drop(*[f"__{k}" for k in keys])


def with_scalars(df: DataFrame, scalars: DataFrame) -> DataFrame:
    """Add the columns of a one-row frame (the result of a global aggregation)."""
    return df.join(F.broadcast(scalars))


def attach_by(df: DataFrame, groups: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add per-group columns, or global ones when there is no group."""
    return attach(df, groups, by) if by else with_scalars(df, groups)


def ordered(
    df: DataFrame,
    order: Sequence[Column],
    by: Sequence[str] = (),
    position: str | None = "position",
    group_size: str | None = None,
    totals: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add 1-based positions and inclusive running totals per ``by`` in ``order``.

    ``order`` has to be unique within ``by`` (add a key column) for a
    reproducible result. ``totals`` maps new column names to numeric columns.
    """
    totals = dict(totals or {})
    sort = [*[F.col(c) for c in by], *order]
    columns = df.columns
    laid_out = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
    rows = materialize(laid_out.withColumn("__at", F.monotonically_increasing_id()))
    rows = rows.select(
        *columns,
        F.shiftrightunsigned("__at", _ROW_BITS).alias("__part"),
        F.col("__at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("__index"),
    )

    if position is not None or group_size is not None:
        # One row per partition, so this window and broadcast stay small.
        offsets = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
        before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
        offsets = offsets.select(
            "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset")
        )
        rows = rows.join(F.broadcast(offsets), "__part").withColumn(
            "__global", F.col("__offset") + F.col("__index") + 1
        )
    if totals:
        local = W.partitionBy("__part", *by).orderBy("__index")
        local = local.rowsBetween(W.unboundedPreceding, W.currentRow)
        parts = rows.groupBy("__part", *by).agg(
            *[F.sum(source).alias(f"__sum_{name}") for name, source in totals.items()]
        )
        # At most one row per partition and group.
        earlier = W.partitionBy(*by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
        parts = parts.select(
            "__part",
            *by,
            *[
                F.coalesce(F.sum(f"__sum_{n}").over(earlier), F.lit(0)).alias(f"__base_{n}")
                for n in totals
            ],
        )
        rows = rows.select(
            "*", *[F.sum(s).over(local).alias(f"__local_{n}") for n, s in totals.items()]
        )
        rows = attach(rows, parts, ["__part", *by])
        rows = rows.select(
            "*", *[(F.col(f"__local_{n}") + F.col(f"__base_{n}")).alias(n) for n in totals]
        )
    extra = list(totals)
    if position is not None and not by:
        rows = rows.withColumn(position, F.col("__global"))
        extra.append(position)
        if group_size is not None:
            size = rows.agg(F.count(F.lit(1)).alias(group_size))
            rows = with_scalars(rows, size)
            extra.append(group_size)
    elif position is not None or group_size is not None:
        groups = rows.groupBy(*by).agg(
            F.min("__global").alias("__first"), F.count(F.lit(1)).alias("__size")
        )
        rows = attach_by(rows, groups, by)
        if position is not None:
            rows = rows.withColumn(position, F.col("__global") - F.col("__first") + 1)
            extra.append(position)
        if group_size is not None:
            rows = rows.withColumn(group_size, F.col("__size"))
            extra.append(group_size)
    return rows.select(*columns, *extra)


def value_counts(
    df: DataFrame, value: str, by: Sequence[str] = (), sums: Mapping[str, Column] | None = None
) -> DataFrame:
    """One row per distinct value: ``n`` plus the given sums."""
    return df.groupBy(*by, value).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(c).alias(name) for name, c in (sums or {}).items()],
    )


def exact_quantiles(
    df: DataFrame,
    value: str,
    probabilities: Mapping[str, float | tuple[float, str]],
    by: Sequence[str] = (),
    method: str = "linear",
) -> DataFrame:
    """Exact quantiles of a numeric column, one output column per probability.

    ``linear`` interpolates between the two middle values, ``nearest`` takes the
    smallest value whose cumulative share reaches the probability; a
    (probability, method) pair overrides the method of one column. Equal values
    are counted before anything is ordered.
    """
    counts = (
        df.select(*by, F.col(value).alias("__value"))
        .filter(F.col("__value").isNotNull())
        .groupBy(*by, "__value")
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    running = ordered(counts, [F.col("__value")], by, position=None, totals={"__upto": "__n"})
    totals = running.groupBy(*by).agg(F.sum("__n").alias("__total"))
    running = attach_by(running, totals, by)
    start = F.col("__upto") - F.col("__n")

    def at(rank: Column) -> Column:
        return F.max(F.when((start <= rank) & (F.col("__upto") > rank), F.col("__value")))

    picks, finals = [], []
    for name, wanted in probabilities.items():
        p, kind = wanted if isinstance(wanted, tuple) else (wanted, method)
        if kind == "nearest":
            rank = F.greatest(F.ceil(F.col("__total") * F.lit(p)) - 1, F.lit(0))
            picks.append(at(rank).alias(name))
            finals.append(F.col(name))
            continue
        h = (F.col("__total") - 1) * F.lit(p)
        picks += [
            at(F.floor(h)).alias(f"__lo_{name}"),
            at(F.ceil(h)).alias(f"__hi_{name}"),
            F.max(h - F.floor(h)).alias(f"__w_{name}"),
        ]
        lo = F.col(f"__lo_{name}").cast("double")
        finals.append((lo + F.col(f"__w_{name}") * (F.col(f"__hi_{name}") - lo)).alias(name))
    return running.groupBy(*by).agg(*picks).select(*by, *finals)
