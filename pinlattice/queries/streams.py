"""Structured Streaming over the event table, run until the input is used up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinlattice.queries.adapters import Tables
from pinlattice.queries.registry import query
from pinlattice.session import shared_folder
from pinlattice.streaming import conversations as conv
from pinlattice.streaming import observations as so


def stream_of(t: Tables) -> DataFrame:
    """The event file as a stream: keys repeat, errors are infrastructure failures."""
    source = so.read_file_stream(t.spark, t.events.schema, f"{t.folder}/events*.parquet")
    return shaped(source)


def shaped(events: DataFrame) -> DataFrame:
    return events.select(
        F.concat_ws("-", F.col("user_id"), F.floor("value")).alias("experiment_id"),
        F.when(F.col("event_type") == "error", "infrastructure_failure")
        .otherwise(F.col("event_type"))
        .alias("outcome"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
        "user_id",
        "value",
    )


EVENT_SQL = """
e as (select concat(cast(user_id as varchar), '-', cast(cast(floor(value) as bigint) as varchar)) as experiment_id,
  case when event_type = 'error' then 'infrastructure_failure' else event_type end as outcome, ts, event_id, user_id, value from events)
"""


@query(
    "stream_observations",
    f"""
with {EVENT_SQL}
select 'valid' as kind, outcome, count(*) as row_count from e where outcome <> 'infrastructure_failure' and value >= 1 group by 2
union all select 'quarantine', outcome, count(*) from e where outcome = 'infrastructure_failure' or value < 1 group by 2
""",
)
def _(t: Tables) -> DataFrame:
    rules = {
        "infrastructure": F.col("outcome") == "infrastructure_failure",
        "too_small": F.col("value") < 1,
    }
    valid, quarantine = so.stream_observations(
        stream_of(t), shared_folder(t.spark, "ingest"), rules
    )
    parts = []
    for kind, path in (("valid", valid), ("quarantine", quarantine)):
        rows = t.spark.read.parquet(path)
        parts.append(
            rows.groupBy("outcome")
            .agg(F.count(F.lit(1)).alias("row_count"))
            .select(F.lit(kind).alias("kind"), "outcome", "row_count")
        )
    return parts[0].unionByName(parts[1])


@query(
    "stream_resume",
    f"""
with {EVENT_SQL}
select experiment_id, arg_min(event_id, {{'t': ts, 'e': event_id}}) as event_id, min(ts) as ts from e where outcome <> 'infrastructure_failure' group by 1
""",
)
def _(t: Tables) -> DataFrame:
    """The stream comes twice, so every experiment is met again after everything was stored."""
    path = shared_folder(t.spark, "resume")
    both = stream_of(t).unionByName(stream_of(t))
    kept = so.stream_resume(both, path, order=("ts", "event_id"))
    return kept.select("experiment_id", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query(
    "append_unseen",
    f"""
with {EVENT_SQL}
select experiment_id, arg_min(event_id, ts) as event_id from e where outcome <> 'infrastructure_failure' group by 1
""",
)
def _(t: Tables) -> DataFrame:
    path = shared_folder(t.spark, "unseen")
    table = f"{path}/table"
    so.run_batches(stream_of(t), path, lambda batch, _: so.append_unseen(batch, table))
    # The same stream again, from its beginning: nothing new is stored.
    so.run_batches(stream_of(t), f"{path}-again", lambda batch, _: so.append_unseen(batch, table))
    return t.spark.read.parquet(table).select("experiment_id", "event_id")


@query(
    "idempotent_messages",
    """
select user_id as conv_id, concat(event_type, cast(cast(floor(value) as bigint) as varchar)) as client_message_id, arg_min(event_id, {'t': ts, 'e': event_id}) as event_id
from events group by 1, 2
""",
)
def _(t: Tables) -> DataFrame:
    source = so.read_file_stream(t.spark, t.events.schema, f"{t.folder}/events*.parquet")
    messages = source.select(
        F.col("user_id").alias("conv_id"),
        F.concat("event_type", F.floor("value").cast("string")).alias("client_message_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
    )
    kept = conv.idempotent_messages(messages, shared_folder(t.spark, "messages"), ("ts", "event_id"))
    return kept.drop("ts")


SESSION_SQL = """
g as (select user_id, ts, case when ts < lag(ts) over w + interval 2 hour then 0 else 1 end as first from events window w as (partition by user_id order by ts, event_id)),
i as (select *, sum(first) over (partition by user_id order by ts rows unbounded preceding) as n from g),
s as (select user_id as conv_id, n, epoch_us(min(ts)) as started, epoch_us(max(ts) + interval 2 hour) as expires, count(*) as turns from i group by 1, 2)
"""


def turns_of(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("conv_id"), F.col("ts").cast("timestamp").alias("ts")
    )


def _micros(sessions: DataFrame) -> DataFrame:
    return sessions.withColumns(
        {c: F.unix_micros(c) for c in ("started", "expires")}
    )


@query(
    "conversation_sessions",
    f"with {SESSION_SQL} select conv_id, started, expires, turns from s",
)
def _(t: Tables) -> DataFrame:
    return _micros(conv.conversation_sessions(turns_of(t.events)))


@query(
    "stream_conversation_sessions",
    f"""
with {SESSION_SQL} select conv_id, started, expires, turns from s where expires <= (select epoch_us(date_trunc('millisecond', max(ts))) - 3600000000 from events)
""",
)
def _(t: Tables) -> DataFrame:
    """Sessions that have expired by the watermark (one hour behind the newest turn)."""
    source = so.read_file_stream(t.spark, t.events.schema, f"{t.folder}/events*.parquet")
    closed = conv.conversation_sessions(turns_of(source), watermark="1 hour")
    return _micros(so.run_to_table(closed, shared_folder(t.spark, "sessions")))


@query(
    "stream_message_limit",
    """
select conv_id, turn, message from (select conv_id, turn, row_number() over (partition by conv_id order by turn) as message from conversations) where message <= 4
""",
)
def _(t: Tables) -> DataFrame:
    """The cap of five messages holds two exchanges; turn numbers are the clock."""
    source = so.read_file_stream(t.spark, t.conversations.schema, f"{t.folder}/conversations*.parquet")
    turns = source.select("conv_id", "turn", F.timestamp_seconds(F.col("turn") + 1_000_000_000).alias("ts"))
    fit = conv.stream_message_limit(turns, 5)
    return so.run_to_table(fit, shared_folder(t.spark, "limits")).drop("ts")


CHAIN_SQL = """
with recursive c as (select user_id, min(ts) as t from events group by 1
  union all select c.user_id, (select min(e.ts) from events e where e.user_id = c.user_id and e.ts >= c.t + interval 86400 second) from c where c.t is not null)
"""


@query(
    "ttl_cache",
    CHAIN_SQL
    + """
select e.user_id as key, epoch_us(e.ts) as at, count(*) as requests, c.t is not null as computed
from events e left join c on c.user_id = e.user_id and c.t = e.ts group by all
""",
)
def _(t: Tables) -> DataFrame:
    """A day instead of 15 minutes, so that the sparse events of a user hit the cache."""
    rows = t.events.select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    cached = so.ttl_cache(rows, ttl=86400)
    return cached.select("key", F.unix_micros("ts").alias("at"), "requests", "computed")


@query(
    "stream_ttl_cache",
    CHAIN_SQL
    + """
, k as (select user_id, count(*) as computed from c where t is not null group by 1)
select e.user_id as key, count(*) as requests, max(k.computed) as computed from events e join k on k.user_id = e.user_id group by 1
""",
)
def _(t: Tables) -> DataFrame:
    source = so.read_file_stream(t.spark, t.events.schema, f"{t.folder}/events*.parquet")
    rows = source.select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    found = so.stream_ttl_cache(rows, shared_folder(t.spark, "ttl"), ttl=86400)
    return found.groupBy("key").agg(
        F.sum("requests").alias("requests"), F.count_if("computed").alias("computed")
    )


@query(
    "live_outcome_counts",
    f"with {EVENT_SQL} select outcome, count(*) as rows from e group by 1",
)
def _(t: Tables) -> DataFrame:
    counts = so.live_outcome_counts(stream_of(t))
    return so.latest_counts(counts, shared_folder(t.spark, "live"))


@query(
    "windowed_outcome_counts",
    f"""
with {EVENT_SQL}, w as (select epoch_us(date_trunc('day', ts)) as window_start, outcome, count(*) as rows from e group by 1, 2)
select window_start, outcome, rows from w where window_start + 86400000000 <= (select epoch_us(date_trunc('millisecond', max(ts))) - 86400000000 from events)
""",
)
def _(t: Tables) -> DataFrame:
    closed = so.windowed_outcome_counts(stream_of(t))
    rows = so.run_to_table(closed, shared_folder(t.spark, "windows"))
    return rows.withColumn("window_start", F.unix_micros("window_start"))
