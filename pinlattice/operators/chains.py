"""Greedy chains in time order without a task per key.

A chain starts at the first time of a key and goes on at the first time at least ``gap``
later, and so on. Each verdict depends on the one before it, but the step from a row to the
first row at least ``gap`` later does not: it is a pointer that range-partitioned running
counts give for all rows at once. Pointer doubling then marks the rows that the chain visits:
after k rounds the first 2 ** k of each chain. A key of any size is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinlattice.operators.ordered import ordered
from pinlattice.session import materialize


def _pointers(times: DataFrame, gap: int) -> DataFrame:
    """(key, time, at, next): position of each distinct time in its key and of the first one ``gap`` later."""
    marks = times.select("key", F.col("time").alias("mark"), F.lit(1).alias("own"), "time")
    # At equal marks a question comes before the time itself, so that time counts as later.
    questions = times.select("key", (F.col("time") + gap).alias("mark"), F.lit(0).alias("own"), "time")
    counted = ordered(marks.unionByName(questions), [F.col("mark"), F.col("own"), F.col("time")], ["key"], position=None, totals={"upto": "own"})
    per_time = counted.groupBy("key", "time").agg(
        F.max(F.when(F.col("own") == 1, F.col("upto"))).alias("at"),
        F.max(F.when(F.col("own") == 0, F.col("upto") + 1)).alias("next"),
    )
    return materialize(per_time)


def greedy_chain(times: DataFrame, gap: int, max_rounds: int = 64) -> DataFrame:
    """(key, time) rows of the chain; ``times`` has distinct (key, time) rows, times as integers.

    Null keys are one key. A time at least ``gap`` after the one before it is visited whatever
    came earlier, so pointers stop there: the number of rounds is the logarithm of the longest
    run of visited times without such a pause, not of the longest history.
    """
    rows = _pointers(times, gap)

    def meet(left: DataFrame, right: DataFrame, on, how: str) -> DataFrame:
        """``right`` has columns k and p and one row per (k, p)."""
        return left.join(right, left["key"].eqNullSafe(right["k"]) & (on == right["p"]), how)

    after_pause = rows.filter(F.col("next") == F.col("at") + 1).select(F.col("key").alias("k"), F.col("next").alias("p"))
    known = rows.select(F.col("key").alias("k"), F.col("at").alias("p"))
    pauses = materialize(meet(rows.select("key", "at"), after_pause, F.col("at"), "left_semi"))
    visited = pauses.unionByName(rows.filter(F.col("at") == 1).select("key", "at"))
    starts = pauses.select(F.col("key").alias("k"), F.col("at").alias("p"))
    inner = meet(rows.select("key", "at", "next"), known, F.col("next"), "left_semi")
    jumps = materialize(meet(inner, starts, F.col("next"), "left_anti"))
    for _ in range(max_rounds):
        if jumps.isEmpty():
            break
        far = jumps.select(F.col("key").alias("k"), F.col("at").alias("p"), F.col("next").alias("to"))
        reached = meet(visited, far, F.col("at"), "inner").select("key", F.col("to").alias("at"))
        visited = materialize(visited.unionByName(reached))
        jumps = materialize(meet(jumps, far, F.col("next"), "inner").select("key", "at", F.col("to").alias("next")))
    chosen = visited.distinct().select(F.col("key").alias("k"), F.col("at").alias("p"))
    return meet(rows, chosen, F.col("at"), "left_semi").select("key", "time")
