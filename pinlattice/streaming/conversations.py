"""Conversation turns: idempotent messages, expiring sessions, caps and recent context."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pinlattice.constants import (
    CONVERSATION_LIMIT,
    MESSAGE_LIMIT,
    RECENT_TURNS,
    SESSION_TTL,
    TURN_WIDTH,
)
from pinlattice.streaming.keyed import KeyedTable, store_first
from pinlattice.streaming.observations import run_batches


def idempotent_messages(
    stream: DataFrame, path: str, order: Sequence[str] = ("ts",), buckets: int = 64, compact_every: int = 100
) -> DataFrame:
    """A repeated (conversation, client message id) keeps the first exchange only, however late it comes again.

    A batch is compared with the stored ids of its own buckets; of its own repeats the first by
    ``order`` is kept. Returns the stored exchanges.
    """
    table = KeyedTable(stream.sparkSession, f"{path}/messages", ("conv_id", "client_message_id"), buckets)
    table.recover()

    def handle(batch: DataFrame, batch_id: int) -> None:
        store_first(batch, batch_id, table, order)
        if compact_every and batch_id % compact_every == compact_every - 1:
            table.compact(batch_id - 1)

    run_batches(stream, path, handle)
    return table.rows(stream)


def conversation_sessions(turns: DataFrame, ttl: str = SESSION_TTL, watermark: str | None = None) -> DataFrame:
    """Sliding expiry: every turn extends the session by ``ttl``. Batch or stream."""
    if watermark is not None:
        turns = turns.withWatermark("ts", watermark)
    window = F.session_window("ts", ttl)
    return (
        turns.groupBy("conv_id", window.alias("w"))
        .agg(F.count(F.lit(1)).alias("turns"))
        .select(
            "conv_id",
            F.col("w.start").alias("started"),
            F.col("w.end").alias("expires"),
            "turns",
        )
    )


def message_limit(turns: DataFrame, limit: int = MESSAGE_LIMIT, order: str = "turn") -> DataFrame:
    """Turns that fit: exchanges of two messages beyond the limit are rejected.

    The row-number filter becomes a per-task limit before the shuffle, so a
    conversation of any length sends at most ``limit`` rows per task.
    """
    window = W.partitionBy("conv_id").orderBy(order)
    return turns.withColumn("message", F.row_number().over(window)).filter(
        F.col("message") <= limit - limit % 2
    )


def stream_message_limit(turns: DataFrame, limit: int = MESSAGE_LIMIT, watermark: str = "1 hour", ttl: str = SESSION_TTL) -> DataFrame:
    """Streaming form of the limit: (conv_id, turn, ts, message) of the turns that fit.

    Keyed state holds how many messages a conversation has. Turns come in pairs of
    one exchange; an exchange that would pass the limit is rejected as a whole, and
    so is every later one. Turns of one key are ordered inside a micro-batch. The
    state of a conversation is freed ``ttl`` after its newest turn.
    """
    types = dict(turns.dtypes)
    schema = f"conv_id {types['conv_id']}, turn {types['turn']}, ts {types['ts']}, message long"
    full = limit - limit % 2
    lifetime = int(pd.Timedelta(ttl).total_seconds() * 1000)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count = state.get[0] if state.exists else 0
        newest = 0
        # What is kept of a batch is at most what still fits.
        kept = None
        for batch in batches:
            newest = max(newest, int(batch["ts"].max().timestamp() * 1000))
            both = batch if kept is None else pd.concat([kept, batch])
            kept = both.nsmallest(max(full - count, 0), "turn", keep="first")
        if kept is not None and len(kept):
            kept = kept.sort_values("turn").assign(message=range(count + 1, count + 1 + len(kept)))
            count += len(kept)
            yield kept[["conv_id", "turn", "ts", "message"]]
        state.update((count,))
        state.setTimeoutTimestamp(max(newest + lifetime, state.getCurrentWatermarkMs() + 1))

    return (
        turns.withWatermark("ts", watermark)
        .select("conv_id", "turn", "ts")
        .groupBy("conv_id")
        .applyInPandasWithState(update, schema, "n long", "append", GroupStateTimeout.EventTimeTimeout)
    )


def evict_oldest(conversations: DataFrame, keep: int = CONVERSATION_LIMIT) -> DataFrame:
    """Newest ``keep`` conversations (conv_id, created)."""
    return conversations.orderBy(F.col("created").desc(), F.col("conv_id").desc()).limit(keep)


def format_turn(role: Column, text: Column) -> Column:
    clean = F.trim(F.replace(text, F.lit("\x00"), F.lit("")))
    who = F.when(role == "user", "user").otherwise("assistant")
    return F.concat(F.lit("["), who, F.lit("] "), F.left(clean, F.lit(TURN_WIDTH)))


def recent_turns(turns: DataFrame, n: int = RECENT_TURNS) -> DataFrame:
    """Last n turns per conversation as one formatted context (a bounded list per conversation)."""
    window = W.partitionBy("conv_id").orderBy(F.col("turn").desc())
    last = turns.withColumn("__rn", F.row_number().over(window)).filter(F.col("__rn") <= n)
    return last.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("turns"),
        F.array_join(
            F.transform(
                F.array_sort(
                    F.collect_list(F.struct("turn", format_turn(F.col("role"), F.col("text")).alias("line")))
                ),
                lambda t: t["line"],
            ),
            "\n",
        ).alias("context"),
    )
