"""Steps written as tables, and joins to a table of unique keys that no hot key can overload."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinlattice.session import shared_folder

# A key is hot when it holds at least this share of all rows, so there are at most HOT_KEYS of them.
HOT_KEYS = 1000


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back; executors can be lost afterwards."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def look_up(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join to ``right``, which has one row per key; keys of either side may be null (no match).

    Rows of hot keys find their value in a broadcast table of at most ``HOT_KEYS`` rows
    and are never shuffled; all other rows are joined by a shuffle. ``left`` is read more
    than once, so hand over a stored table.
    """
    on = list(on)
    counts = left.dropna(subset=on).groupBy(*on).agg(F.count(F.lit(1)).alias("__rows"))
    total = left.count()
    hot = F.broadcast(counts.filter(F.col("__rows") * HOT_KEYS >= max(total, 1)).select(*on))
    marked = left.join(hot.withColumn("__hot", F.lit(True)), on, "left")
    cold = marked.filter(F.col("__hot").isNull()).drop("__hot").join(right, on, "left")
    warm = marked.filter(F.col("__hot")).drop("__hot").join(F.broadcast(right.join(hot, on, "left_semi")), on, "left")
    return cold.unionByName(warm)
