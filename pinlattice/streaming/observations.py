"""Continuous ingest of observation rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pinlattice.constants import VERDICT_TTL_SECONDS
from pinlattice.operators.chains import greedy_chain
from pinlattice.operators.observations import INFRASTRUCTURE, result_rules
from pinlattice.operators.violations import broken_rules
from pinlattice.session import materialize
from pinlattice.sources.writers import append_rows, read_existing
from pinlattice.streaming.keyed import KeyedTable, first_rows, store_first


def read_file_stream(spark: SparkSession, schema: str | StructType, path: str, fmt: str = "parquet", files_per_trigger: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .format(fmt)
        .load(path)
    )


def run_to_table(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Process what is there, then stop; return the table that was written."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", f"{path}/table")
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/table")


def run_batches(stream: DataFrame, path: str, handle: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{path}/checkpoint")
        .foreachBatch(handle)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def stream_observations(stream: DataFrame, path: str, rules=None) -> tuple[str, str]:
    """Valid rows go to ``<path>/valid``, others with their reasons to ``<path>/quarantine``.

    A batch that is run again replaces its own folder, so a restart adds no row twice.
    """
    conditions = result_rules() if rules is None else rules
    valid, quarantine = f"{path}/valid", f"{path}/quarantine"

    def handle(batch: DataFrame, batch_id: int) -> None:
        checked = batch.withColumn("reasons", broken_rules(conditions)).persist()
        good = checked.filter(F.size("reasons") == 0).drop("reasons")
        bad = checked.filter(F.size("reasons") > 0)
        good.write.mode("overwrite").parquet(f"{valid}/batch={batch_id}")
        bad.write.mode("overwrite").parquet(f"{quarantine}/batch={batch_id}")
        checked.unpersist()

    run_batches(stream, path, handle)
    return valid, quarantine


def stream_resume(
    stream: DataFrame, path: str, key: str = "experiment_id", order: Sequence[str] = ("ts",), buckets: int = 64, compact_every: int = 100
) -> DataFrame:
    """Every experiment once and for all; infrastructure failures are not results and may come again.

    Of the rows of one batch the first by ``order`` is kept. What is stored is exact however late an
    experiment comes again: a batch is compared with the stored keys of its own buckets. Returns
    the stored table; ``stream`` must not have columns named ``batch`` or ``bucket``.
    """
    table = KeyedTable(stream.sparkSession, f"{path}/rows", (key,), buckets)
    table.recover()

    def handle(batch: DataFrame, batch_id: int) -> None:
        finished = batch.filter(F.coalesce(F.col("outcome") != INFRASTRUCTURE, F.lit(True)))
        store_first(finished, batch_id, table, order)
        if compact_every and batch_id % compact_every == compact_every - 1:
            table.compact(batch_id - 1)

    run_batches(stream, path, handle)
    return table.rows(stream)


def resume_within_watermark(stream: DataFrame, watermark: str = "1 day", key: str = "experiment_id") -> DataFrame:
    """The cheaper rule for streams whose repeats come soon: once within the watermark, later rows are dropped."""
    finished = stream.filter(F.col("outcome") != INFRASTRUCTURE)
    return finished.withWatermark("ts", watermark).dropDuplicatesWithinWatermark([key])


def append_unseen(batch: DataFrame, table: str, key: str = "experiment_id", order: str = "ts") -> None:
    """Batch form of the resume rule for a plain table: all its keys are read."""
    finished = batch.filter(F.col("outcome") != INFRASTRUCTURE)
    fresh = first_rows(finished, [key], [order])
    stored = read_existing(batch.sparkSession, table)
    if stored is not None:
        fresh = fresh.join(stored.select(key), key, "left_anti")
    append_rows(fresh, table)


def live_outcome_counts(stream: DataFrame) -> DataFrame:
    """Running rows per outcome; use output mode complete or update."""
    return stream.groupBy("outcome").agg(F.count(F.lit(1)).alias("rows"))


def windowed_outcome_counts(stream: DataFrame, width: str = "1 day", watermark: str = "1 day") -> DataFrame:
    return (
        stream.withWatermark("ts", watermark)
        .groupBy(F.window("ts", width).alias("w"), "outcome")
        .agg(F.count(F.lit(1)).alias("rows"))
        .select(F.col("w.start").alias("window_start"), "outcome", "rows")
    )


def latest_counts(stream: DataFrame, path: str, key: str = "outcome") -> DataFrame:
    """Run ``live_outcome_counts`` in update mode and keep the newest count per key."""
    target = f"{path}/counts"

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(
            f"{target}/run={batch_id}"
        )

    run_batches(stream, path, handle, mode="update")
    updates = stream.sparkSession.read.parquet(target)
    return updates.groupBy(key).agg(F.max_by("rows", "batch").alias("rows"))


def ttl_cache(df: DataFrame, ttl: int = VERDICT_TTL_SECONDS, key: str = "key", ts: str = "ts") -> DataFrame:
    """Batch form: (key, ts, requests, computed): a hit does not extend the cached verdict.

    A verdict is computed at the first time of a key and at the first time at least ``ttl`` seconds
    after the last computation; ``greedy_chain`` finds those without a task per key. Null keys are one
    key; a request without a time has no verdict (``computed`` is null).
    """
    counted = df.groupBy(F.col(key), F.col(ts)).agg(F.count(F.lit(1)).alias("requests"))
    counted = materialize(counted.withColumn("__t", F.unix_micros(F.col(ts).cast("timestamp"))))
    times = counted.dropna(subset=["__t"]).select(F.col(key).alias("key"), F.col("__t").alias("time")).distinct()
    chain = greedy_chain(times, ttl * 1_000_000).select(F.col("key").alias("__k"), F.col("time").alias("__at"), F.lit(True).alias("__hit"))
    met = counted.join(chain, counted[key].eqNullSafe(chain["__k"]) & (counted["__t"] == chain["__at"]), "left")
    computed = F.when(F.col("__t").isNotNull(), F.col("__hit").isNotNull())
    return met.select(key, ts, "requests", computed.alias("computed"))


def stream_ttl_cache(
    stream: DataFrame, path: str, ttl: int = VERDICT_TTL_SECONDS, key: str = "key", ts: str = "ts", buckets: int = 64, compact_every: int = 100
) -> DataFrame:
    """Streaming form: (key, ts, requests, computed) of all batches so far.

    The time of each key's newest computation is stored by batch and bucket. A batch reads those of
    its own keys, puts them in front of its requests and resolves the chains as the batch form does,
    so a hot key is spread over all tasks. Requests older than the stored computation are hits.
    """
    spark = stream.sparkSession
    table = KeyedTable(spark, f"{path}/newest", ("key",), buckets)
    table.recover()
    verdicts = f"{path}/verdicts"

    def handle(batch: DataFrame, batch_id: int) -> None:
        micros = F.unix_micros(F.col(ts).cast("timestamp"))
        counted = materialize(batch.groupBy(F.col(key).alias("key"), micros.alias("time")).agg(F.count(F.lit(1)).alias("requests")))
        asked = counted.dropna(subset=["time"]).select("key", "time")
        stored = table.earlier(batch_id, counted.select("key"))
        if stored is None:
            before = asked.groupBy("key").agg(F.lit(None).cast("long").alias("newest"))
        else:
            before = stored.groupBy("key").agg(F.max("newest").alias("newest"))
        before = materialize(before.toDF("__k", "newest"))
        # The newest computation of an earlier batch opens the chain; what is older is a hit.
        met = asked.join(before, asked["key"].eqNullSafe(before["__k"]), "left")
        later = met.filter(F.coalesce(F.col("time") > F.col("newest"), F.lit(True))).select("key", "time")
        opened = before.filter(F.col("newest").isNotNull()).select(F.col("__k").alias("key"), F.col("newest").alias("time"))
        chain = greedy_chain(later.unionByName(opened), ttl * 1_000_000)
        old = opened.select(F.col("key").alias("__k"), F.col("time").alias("__at"))
        fresh = materialize(chain.join(old, chain["key"].eqNullSafe(old["__k"]) & (chain["time"] == old["__at"]), "left_anti"))
        new = fresh.select(F.col("key").alias("__k"), F.col("time").alias("__at"))
        found = counted.join(new, counted["key"].eqNullSafe(new["__k"]) & (counted["time"] == new["__at"]), "left")
        computed = F.when(F.col("time").isNotNull(), F.col("__at").isNotNull()).alias("computed")
        out = found.select("key", F.timestamp_micros("time").alias("ts"), "requests", computed)
        out.write.mode("overwrite").parquet(f"{verdicts}/batch={batch_id}")
        table.put(batch_id, fresh.groupBy("key").agg(F.max("time").alias("newest")))
        if compact_every and batch_id % compact_every == compact_every - 1:
            table.compact(batch_id - 1)

    run_batches(stream, path, handle)
    return spark.read.parquet(verdicts).drop("batch")
