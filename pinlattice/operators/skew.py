"""Joins whose output per task stays bounded, however hot a key is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _content(df: DataFrame) -> Column:
    return F.xxhash64(*[F.col(c) for c in df.columns])


def spread_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], rows_per_cell: int = 20_000
) -> DataFrame:
    """Inner equi-join that cuts every hot key into a grid of cells.

    Both sides are counted per key (pre-aggregated). A key with more than
    ``rows_per_cell`` rows on a side is salted on that side and repeated on the
    other, so one task never has to pair more than ``rows_per_cell`` rows of
    each side. Cold keys pass through with one cell. Needs no maps in the input.
    """
    on = list(on)
    cells = (
        left.groupBy(*on)
        .agg(F.count(F.lit(1)).alias("__nl"))
        .join(right.groupBy(*on).agg(F.count(F.lit(1)).alias("__nr")), on)
        .select(
            *on,
            F.ceil(F.col("__nl") / rows_per_cell).cast("int").alias("__sl"),
            F.ceil(F.col("__nr") / rows_per_cell).cast("int").alias("__sr"),
        )
        .filter((F.col("__sl") > 1) | (F.col("__sr") > 1))
    )

    def salted(df: DataFrame, own: str, other: str, own_salt: str, other_salt: str) -> DataFrame:
        widened = df.withColumn("__h", _content(df)).join(cells, on, "left")
        own_n, other_n = F.coalesce(own, F.lit(1)), F.coalesce(other, F.lit(1))
        return widened.select(
            *df.columns,
            F.pmod(F.col("__h"), own_n).cast("int").alias(own_salt),
            F.explode(F.sequence(F.lit(0), other_n - 1)).alias(other_salt),
        )

    return (
        salted(left, "__sl", "__sr", "__a", "__b")
        .join(salted(right, "__sr", "__sl", "__b", "__a"), [*on, "__a", "__b"])
        .drop("__a", "__b")
    )
