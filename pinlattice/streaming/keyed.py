"""Keys and rows that a stream has stored for good, laid out so that a batch reads few of them.

State held by a streaming query has to be freed some day; what must be exact for ever is stored
here. A table of this kind is a folder of batches, each cut into buckets of a hash of the key:
``<path>/batch=<n>/bucket=<b>``. A micro-batch reads only the buckets its own keys fall into, and
of those only the columns it asks for. A batch that is run again does not see its own earlier
rows and replaces its folder, so a restart changes nothing. ``compact`` joins finished batches
into one folder, so that a long-lived stream does not read thousands of small files.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pinlattice.sources.writers import read_existing

# Layout columns; data columns of these names are not allowed.
LAYOUT = ("batch", "bucket")


@dataclass(frozen=True)
class KeyedTable:
    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    # A fixed parameter: the number of buckets of a stored table cannot change.
    buckets: int = 64

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k) for k in self.keys]), F.lit(self.buckets)).cast("int")

    def earlier(self, batch_id: int, batch: DataFrame) -> DataFrame | None:
        """Stored rows of earlier batches whose key is in ``batch``; None where nothing is stored yet."""
        stored = read_existing(self.spark, self.path)
        if stored is None:
            return None
        # At most ``buckets`` numbers.
        wanted = [r[0] for r in batch.select(self.bucket().alias("b")).distinct().collect()]
        near = stored.filter(F.col("bucket").isin(wanted) & (F.col("batch") < batch_id))
        asked = batch.select(*[F.col(k).alias(f"__{k}") for k in self.keys]).distinct()
        same = F.lit(True)
        for k in self.keys:
            same = same & near[k].eqNullSafe(asked[f"__{k}"])
        return near.join(asked, same, "left_semi").drop("bucket")

    def put(self, batch_id: int, rows: DataFrame) -> None:
        clash = set(LAYOUT) & set(rows.columns)
        if clash:
            raise ValueError(f"layout columns in the data: {sorted(clash)}")
        laid = rows.withColumn("bucket", self.bucket()).repartition("bucket")
        laid.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/batch={batch_id}")

    def rows(self, like: DataFrame) -> DataFrame:
        """All stored rows; ``like`` gives the columns where nothing is stored."""
        stored = read_existing(self.spark, self.path)
        return self.spark.createDataFrame([], like.schema) if stored is None else stored.select(*like.columns)

    def compact(self, upto: int) -> None:
        """Joins the batches up to ``upto`` (all finished) into the folder of that number.

        The joined rows are complete under a hidden name before any old folder goes.
        """
        stored = read_existing(self.spark, self.path)
        if stored is None:
            return
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        old = [n for n in names if n.startswith("batch=") and int(n.split("=")[1]) <= upto]
        if len(old) < 2:
            return
        # Readers skip names with a leading underscore.
        staged = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_joined-{upto}")
        joined = stored.filter(F.col("batch") <= upto).drop("batch")
        joined.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(staged.toString())
        for name in old:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), True)
        if not fs.rename(staged, jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch={upto}")):
            raise OSError(f"cannot publish {self.path}/batch={upto}")

    def recover(self) -> None:
        """Finish a ``compact`` that was interrupted after its joined rows were complete."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return
        for name in [s.getPath().getName() for s in fs.listStatus(root)]:
            if not name.startswith("_joined-"):
                continue
            staged = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            upto = int(name.rpartition("-")[2])
            complete = fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS"))
            if not complete:
                fs.delete(staged, True)
                continue
            for other in [s.getPath().getName() for s in fs.listStatus(root)]:
                if other.startswith("batch=") and int(other.split("=")[1]) <= upto:
                    fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{other}"), True)
            fs.rename(staged, jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch={upto}"))


def first_rows(batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by ``order`` and, at ties, by all other columns; a map-side aggregate."""
    rest = [c for c in batch.columns if c not in keys]
    sort = [*order, *[c for c in rest if c not in order]]
    first = batch.groupBy(*keys).agg(F.min(F.struct(*sort)).alias("__first"))
    return first.select(*keys, "__first.*").select(*batch.columns)


def store_first(batch: DataFrame, batch_id: int, table: KeyedTable, order: Sequence[str]) -> DataFrame:
    """foreachBatch step: stores the first row of each key that no earlier batch has stored."""
    fresh = first_rows(batch, table.keys, order)
    stored = table.earlier(batch_id, fresh)
    if stored is not None:
        seen = stored.select(*[F.col(k).alias(f"__{k}") for k in table.keys])
        same = F.lit(True)
        for k in table.keys:
            same = same & fresh[k].eqNullSafe(seen[f"__{k}"])
        fresh = fresh.join(seen, same, "left_anti")
    table.put(batch_id, fresh)
    return fresh
