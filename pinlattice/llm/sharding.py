"""Uniform sharding with exact shard sizes through a hypergeometric communication matrix.

Rows belong to source blocks by a hash of their key. From the block counts an
exact matrix (rows of each block for each shard) is drawn, hypergeometric as if
one global permutation had dealt the rows. Every block is permuted on its own and
cut by its row of the matrix, the rows are exchanged to their shards, and each
shard is permuted again; sub-blocks of a shard get consecutive slot ranges, so no
task ever sorts a whole shard. All of it is a uniform shuffle with shard sizes at
most one apart (law ``rows``). The row work is DataFrame functions only; numpy
draws the small matrix on the driver, one row per block of ``BLOCK_ROWS`` rows.

The random order is a hash of the seed and the row, so a lost task is repeated
with the same result. Defined results: null keys and null columns are ordinary
values; equal rows are interchangeable and get distinct slots; an empty table
gives no rows; columns named like a new one are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK_ROWS = 50_000
SEED = 20240607


def exact_sizes(rows: int, shards: int) -> np.ndarray:
    """Shard sizes that sum to ``rows`` and are at most one apart."""
    return np.array([rows // shards + (s < rows % shards) for s in range(shards)], np.int64)


def communication_matrix(blocks: Sequence[int], sizes: Sequence[int], seed: int = SEED) -> np.ndarray:
    """Rows of each block for each shard; margins are exactly ``blocks`` and ``sizes``.

    Block after block and shard after shard, one hypergeometric draw without
    replacement from the seats that are left.
    """
    rng = np.random.default_rng(seed)

    def draw(good: int, bad: int, n: int) -> int:
        if good + bad < 10**9:
            return int(rng.hypergeometric(good, bad, n))
        # The generator ends here; the normal limit is exact to far below one row's noise.
        p, size = good / (good + bad), good + bad
        spread = np.sqrt(n * p * (1 - p) * (size - n) / (size - 1))
        return int(np.clip(round(rng.normal(n * p, spread)), max(0, n - bad), min(good, n)))

    blocks, left = np.asarray(blocks, np.int64), np.asarray(sizes, np.int64).copy()
    out = np.zeros((len(blocks), len(left)), np.int64)
    for b, n in enumerate(blocks):
        rest = int(n)
        for s in range(len(left) - 1):
            others = int(left[s + 1 :].sum())
            drawn = draw(int(left[s]), others, rest) if rest else 0
            out[b, s] = drawn
            rest -= drawn
        out[b, -1] += rest
        left -= out[b]
    return out


def _random(seed: int, salt: int, cells: Sequence[Column]) -> Column:
    return F.xxhash64(F.lit(seed), F.lit(salt), *cells)


def shard_rows(
    df: DataFrame,
    shards: int,
    key: Sequence[str],
    seed: int = SEED,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``df`` with ``shard`` (0 to shards - 1) and ``slot`` (0, 1, ... within the shard)."""
    keep = [c for c in df.columns if c not in ("shard", "slot")]
    cells = [df[c] for c in key]
    total = df.count()
    n_blocks = max(1, -(-total // block_rows))
    keyed = df.select(
        *[df[c] for c in keep],
        F.pmod(_random(seed, 1, cells), F.lit(n_blocks)).cast("int").alias("__block"),
        _random(seed, 2, cells).alias("__first"),
        _random(seed, 3, cells).alias("__second"),
    )
    counts = np.zeros(n_blocks, np.int64)
    for block, n in keyed.groupBy("__block").count().collect():  # one row per block
        counts[block] = n
    matrix = communication_matrix(counts, exact_sizes(total, shards), seed)
    upto = matrix.cumsum(axis=1)
    spark = df.sparkSession
    dealt = spark.createDataFrame([(b, [int(x) for x in row]) for b, row in enumerate(upto)], "__block int, __upto array<long>")

    # Permute each block, and cut it by its row of the matrix.
    in_block = W.partitionBy("__block").orderBy("__first", "__second")
    ranked = keyed.withColumn("__rank", F.row_number().over(in_block))
    sent = ranked.join(dealt, "__block").withColumn(
        "shard", F.size(F.filter("__upto", lambda bound: bound < F.col("__rank"))).cast("int")
    )

    # Exchange, and permute again: sub-blocks by the leading part of a second random number.
    subs = max(1, -(-total // (shards * block_rows)))
    sent = sent.withColumn("__sub", F.pmod(F.shiftrightunsigned("__second", 20), F.lit(subs)).cast("int"))
    sizes = sent.groupBy("shard", "__sub").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy("shard").orderBy("__sub").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("shard", "__sub", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    in_sub = W.partitionBy("shard", "__sub").orderBy("__second", "__first")
    slotted = sent.withColumn("__slot", F.row_number().over(in_sub)).join(offsets, ["shard", "__sub"])
    return slotted.select(*keep, "shard", (F.col("__offset") + F.col("__slot") - 1).cast("long").alias("slot"))
