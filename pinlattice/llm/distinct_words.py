"""A table of distinct words, looked up once each and joined back to the texts.

The vocabulary of a corpus grows without bound, so it is never broadcast. Texts
are packed into blocks of about ``BLOCK_BYTES`` (compressed columnar bytes, one
row each). Every block lists its own distinct words, packed by the part of the
word table (a hash of the word) they belong to. The lists meet by part, where each
distinct word of the corpus is looked up once, and go back to their blocks with
the values. A hot word costs one entry per block, however often it occurs.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Sequence
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from pinlattice.llm.batches import cuts, text_bytes

BLOCK_BYTES = 16 << 20
_OPTIONS = pa.ipc.IpcWriteOptions(compression="zstd")


def _pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=_OPTIONS) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


def text_blocks(source: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (block, payload): runs of rows of ``source``, whose last column is the text."""
    width = len(source.columns) - 1

    def run(batches):
        for batch in batches:
            _, offsets = text_bytes(batch.column(width))
            for i, j in cuts(offsets, block_bytes):
                # A copy holds only its own rows' buffers.
                payload = _pack(pa.RecordBatch.from_arrays([pa.concat_arrays([c.slice(i, j - i)]) for c in batch.columns], names=batch.schema.names))
                key = int.from_bytes(hashlib.blake2b(payload, digest_size=8).digest(), "little", signed=True)
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([payload], pa.binary())], names=["block", "payload"])

    return source.mapInArrow(run, "block long, payload binary")


def _write_words(words: Sequence[str]) -> bytes:
    return zstandard.compress("\n".join(words).encode(), 3)


def _read_words(payload: bytes) -> list[str]:
    return zstandard.decompress(payload).decode().split("\n")


def _write_values(values: Sequence[bytes]) -> bytes:
    lengths = np.fromiter(map(len, values), np.uint32, len(values))
    return zstandard.compress(lengths.tobytes() + b"".join(values), 3)


def _read_values(payload: bytes, n: int) -> list[bytes]:
    raw = zstandard.decompress(payload)
    ends = 4 * n + np.cumsum(np.frombuffer(raw[: 4 * n], np.uint32)).astype(np.int64)
    return [raw[a:b] for a, b in zip([4 * n, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def word_part(word: Column, parts: int) -> Column:
    """The part of the word table that holds a word."""
    return (F.crc32(word.cast("binary")) % parts).cast("int")


def join_words(
    docs: DataFrame,
    text: str,
    words_of: Callable[[pa.ChunkedArray], Iterable[str]],
    values_of: Callable[[list[str], dict[str, object]], Sequence[bytes]],
    combine: Callable[..., Sequence[Sequence]],
    fields: Sequence[StructField],
    keep: Sequence[str] | None = None,
    facts: DataFrame | None = None,
    block_bytes: int = BLOCK_BYTES,
    beside: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``docs`` with columns computed from the looked-up words of each text.

    ``words_of`` yields the distinct words of some texts (without line breaks),
    ``values_of`` gives a value to each of some distinct words (with what ``facts``,
    a frame of ``word`` and one more column, knows of them), and ``combine`` gets
    texts with all their distinct words and values and returns the new columns.
    ``beside`` makes rows (block, words, vals) of its own from the blocks; ``combine``
    then gets those of the block too, as a list of (words, vals).
    """
    new = [f.name for f in fields]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]
    names = [f"c{i}" for i in range(len(keep))]
    source = docs.select(*[docs[c].alias(n) for c, n in zip(keep, names, strict=True)], docs[text].alias("text"))
    spark = docs.sparkSession
    size = source.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(shuffled, -(-size // (4 * block_bytes)))
    # Both branches below read this one exchange.
    blocks = text_blocks(source, block_bytes).repartition(max(shuffled, -(-size // block_bytes)), "block")

    def list_words(batches):
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                lists: dict[int, list[str]] = defaultdict(list)
                for word in words_of(unpack(payload.as_buffer()).column("text")):
                    lists[crc32(word.encode()) % parts].append(word)
                if not lists:
                    continue
                # Sorted words share beginnings, which compresses well.
                packed = [_write_words(sorted(words)) for words in lists.values()]
                columns = [pa.array([block] * len(lists), pa.int64()), pa.array(list(lists), pa.int32()), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "part", "words"])

    def look_up(table: pa.Table, known: dict[str, object]) -> pa.Table:
        lists = [_read_words(x.as_buffer()) for x in table.column("words")]
        distinct = sorted(set().union(*lists))
        value = dict(zip(distinct, values_of(distinct, known), strict=True))
        packed = [_write_values([value[w] for w in words]) for words in lists]
        return pa.table([table.column("block"), table.column("words"), pa.array(packed, pa.binary())], names=["block", "words", "vals"])

    listed = blocks.mapInArrow(list_words, "block long, part int, words binary")
    shape = "block long, words binary, vals binary"
    if facts is None:
        valued = listed.groupBy("part").applyInArrow(lambda table: look_up(table, {}), shape)
    else:
        fact = next(c for c in facts.columns if c != "word")
        placed = facts.select(word_part(F.col("word"), parts).alias("part"), "word", F.col(fact).alias("fact"))

        def with_facts(table: pa.Table, side: pa.Table) -> pa.Table:
            if not table.num_rows:
                return pa.table([pa.array([], t) for t in (pa.int64(), pa.binary(), pa.binary())], names=["block", "words", "vals"])
            return look_up(table, dict(zip(side.column("word").to_pylist(), side.column("fact").to_pylist(), strict=True)))

        valued = listed.groupBy("part").cogroup(placed.groupBy("part")).applyInArrow(with_facts, shape)
    valued = valued.withColumn("own", F.lit(True))
    with_listed = beside is not None
    if with_listed:
        valued = valued.union(beside(blocks).withColumn("own", F.lit(False)))
    schema = StructType([*[StructField(n, source.schema[n].dataType) for n in names], *fields])

    def put_back(left: pa.Table, right: pa.Table) -> pa.Table:
        words: list[str] = []
        values: list[bytes] = []
        listed = []
        for packed, payload, own in zip(right.column("words"), right.column("vals"), right.column("own").to_pylist(), strict=True):
            if not own:
                listed.append((packed.as_buffer(), payload.as_buffer()))
                continue
            part = _read_words(packed.as_buffer())
            words += part
            values += _read_values(payload.as_buffer(), len(part))
        extra = [listed] if with_listed else []
        out = []
        for payload in left.column("payload"):
            rows = unpack(payload.as_buffer())
            columns = [rows.column(n) for n in names]
            columns += [v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v) for v in combine(rows.column("text"), words, values, *extra)]
            out.append(pa.table(columns, names=[*names, *new]))
        return pa.concat_tables(out)

    joined = blocks.groupBy("block").cogroup(valued.groupBy("block")).applyInArrow(put_back, schema)
    return joined.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], *new)
