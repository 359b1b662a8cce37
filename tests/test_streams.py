"""Exact stream state and greedy chains against plain loops."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from pinlattice.operators.chains import greedy_chain
from pinlattice.streaming import conversations as conv
from pinlattice.streaming import observations as so
from pinlattice.streaming.keyed import KeyedTable

DAY = 86_400


def chain_of(times, gap):
    out, last = [], None
    for t in sorted(times):
        if last is None or t - last >= gap:
            out.append(t)
            last = t
    return out


@pytest.mark.parametrize("gap", [1, 7, 100, 10_000])
def test_chain_of_one_key_with_all_rows(spark, gap):
    r = random.Random(gap)
    times = sorted(r.sample(range(30_000), 3000))
    frame = spark.createDataFrame([("hot", t) for t in times], "key string, time long").repartition(8)
    assert [t for _, t in rows(greedy_chain(frame, gap), "key", "time")] == sorted(chain_of(times, gap), key=lambda t: repr(("hot", t)))


def test_chains_of_many_keys(spark):
    r = random.Random(3)
    data = {(r.choice([None, "a", "b", "c"]), r.randrange(-500, 2000)) for _ in range(900)} | {("one", 5)}
    frame = spark.createDataFrame(sorted(data, key=repr), "key string, time long")
    got = {(x.key, x.time) for x in greedy_chain(frame, 40).collect()}
    assert got == {(k, t) for k in {k for k, _ in data} for t in chain_of([t for j, t in data if j == k], 40)}
    assert greedy_chain(frame.limit(0), 40).collect() == []


def test_requests_without_a_time_have_no_verdict(spark):
    frame = spark.createDataFrame([("a", None), ("a", 3), (None, None)], "key string, s long").select("key", F.timestamp_seconds("s").alias("ts"))
    got = {(x.key, x.ts is None): x.computed for x in so.ttl_cache(frame, 10).collect()}
    assert got == {("a", True): None, ("a", False): True, (None, True): None}


def file_of(spark, folder, name, data, columns):
    df = spark.createDataFrame(data, columns + ", s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    df.coalesce(1).write.mode("append").parquet(f"{folder}/{name}")
    return df.schema


def test_resume_after_months_and_replays(spark, folder):
    columns = "experiment_id string, outcome string, n long"

    def step():
        return so.stream_resume(so.read_file_stream(spark, schema, f"{folder}/in"), f"{folder}/out", order=("ts", "n"), buckets=4, compact_every=2)

    schema = file_of(spark, folder, "in", [("a", "pass", 1, 10), ("a", "pass", 0, 10), ("b", "infrastructure_failure", 2, 11), ("a", "pass", 3, 5 + DAY)], columns)
    assert rows(step(), "experiment_id", "n") == [("a", 0)]
    for days in (1, 61, 200):
        file_of(spark, folder, "in", [("a", "pass", 9, days * DAY), ("b", "pass", days, days * DAY), (None, "pass", days, 1)], columns)
        found = rows(step(), "experiment_id", "n")
        assert found == [("a", 0), ("b", 1), (None, 1)]
    # A row from long ago is new if its key is.
    file_of(spark, folder, "in", [("late", "pass", 5, 1)], columns)
    assert ("late", 5) in rows(step(), "experiment_id", "n")


def test_nothing_stored_yet(spark, folder):
    schema = file_of(spark, folder, "in", [("b", "infrastructure_failure", 2, 11)], "experiment_id string, outcome string, n long")
    assert so.stream_resume(so.read_file_stream(spark, schema, f"{folder}/in"), f"{folder}/out").collect() == []


def test_messages_keep_the_first_exchange_for_good(spark, folder):
    columns = "conv_id string, client_message_id string, text string"

    def step():
        return conv.idempotent_messages(so.read_file_stream(spark, schema, f"{folder}/in"), f"{folder}/out", ("ts", "text"), buckets=3)

    schema = file_of(spark, folder, "in", [("c", "1", "second", 20), ("c", "1", "first", 10), ("d", "1", "x", 10)], columns)
    step()
    file_of(spark, folder, "in", [("c", "1", "earlier but later seen", 1), ("c", "2", "y", 90 * DAY), ("c", "1", "again", 90 * DAY)], columns)
    assert rows(step(), "conv_id", "client_message_id", "text") == [("c", "1", "first"), ("c", "2", "y"), ("d", "1", "x")]


def test_keyed_table_replays_reads_its_buckets_and_compacts(spark, folder):
    table = KeyedTable(spark, f"{folder}/t", ("k",), 8)
    table.recover()
    data = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    table.put(0, data.filter("k < 20"))
    table.put(1, data.filter("k >= 20"))
    asked = data.filter("k in (3, 25, 99)")
    assert rows(table.earlier(1, asked), "k") == [(3,)] and rows(table.earlier(2, asked), "k") == [(25,), (3,)]
    plan = table.earlier(2, asked)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:200]
    table.put(1, data.filter("k >= 30"))
    assert table.rows(data).count() == 30
    table.compact(1)
    table.put(2, data.filter("k = 25"))
    assert rows(table.rows(data), "k", "v") == rows(data.filter("k < 20 or k >= 30 or k = 25"))
    with pytest.raises(ValueError):
        table.put(3, data.withColumn("bucket", F.lit(1)))


def test_cache_on_a_stream_with_one_hot_key(spark, folder):
    r = random.Random(5)
    data = [("hot" if r.random() < 0.9 else "cold", r.randrange(5000)) for _ in range(1200)]
    data.sort(key=lambda x: x[1])
    found = None
    for i in range(3):
        schema = file_of(spark, folder, "in", data[i * 400 : (i + 1) * 400], "key string")
        found = so.stream_ttl_cache(so.read_file_stream(spark, schema, f"{folder}/in"), f"{folder}/out", ttl=37)
    got = sorted((x.key, x.s) for x in found.filter("computed").withColumn("s", F.unix_timestamp("ts")).collect())
    want = sorted((k, t) for k in ("hot", "cold") for t in chain_of([t for j, t in data if j == k], 37))
    assert got == want and found.agg(F.sum("requests")).first()[0] == 1200
