"""Document fingerprints by a threshold-scaled sketch.

A text's shingles are its runs of ``SHINGLE`` UTF-8 bytes (the whole text where it is
shorter). The sketch keeps every distinct shingle hash below ``1 / SCALE`` of the range
of hashes, so its size follows the text, and the sketch of a union of texts is the union
of their sketches: containment can be estimated between a line and a whole source. Where
no hash is below the threshold, the smallest one is kept; a merge keeps it only where no
merged sketch has a hash below the threshold, so sketches stay mergeable and only empty
texts have an empty sketch.

``sketch_texts`` sketches rows in one pass. ``containment``, ``likeness`` and
``merged_sketches`` work on sketches as arrays of integers. ``compare_edited`` compares each
text with an edited copy and with its successor by id.

Defined results: a null text counts as empty; empty texts have an empty sketch, two empty
sketches are alike (1), an empty and another are not (0). Equal texts have equal sketches.
Rows are ordered by id (null first), then by text hash; rows equal in both are in no
particular order. The successor of the last row is the first. Columns named like a new one
are replaced, all others stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from pinlattice.llm.batches import SLICE_BYTES, Piece, add_columns, group_runs, mix, pieces, text_bytes
from pinlattice.llm.stored import stored

SHINGLE = 16
SCALE = 32
HASH_BITS = 48
_HASH_BYTES = HASH_BITS // 8
_BASE = 0xA24BAED4963EE407
_CODE = mix(np.arange(11, 267, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _windows(data: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hash of every run of ``length`` bytes, put together from runs of powers of two."""
    run, size = _CODE[data], 1
    out, done = None, 0
    left = length
    while left:
        if left & 1:
            weight = np.uint64(pow(_BASE, done, 1 << 64))
            out = run if out is None else out[: len(data) - done - size + 1] + weight * run[done : len(data) - size + 1]
            done += size
        left >>= 1
        if left:
            run = run[: len(run) - size] + np.uint64(pow(_BASE, size, 1 << 64)) * run[size:]
            size *= 2
    return out


def sketches(piece: Piece, shingle: int = SHINGLE, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets) of the texts of a piece: each text's kept hashes, ascending."""
    data, offsets = piece.data, piece.offsets
    lengths = np.diff(offsets)
    n = len(data)
    if n >= shingle:
        hashes = mix(_windows(data, shingle)) >> np.uint64(64 - HASH_BITS)
        owner = np.repeat(np.arange(piece.n), lengths)
        whole = owner[: n - shingle + 1] == owner[shingle - 1 :]
        low = whole & (hashes < np.uint64((1 << HASH_BITS) // scale))
        at = np.flatnonzero(low)
        kept, owners = hashes[at], owner[at]
    else:
        hashes = whole = None
        kept, owners = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # Texts with no hash below the threshold keep their smallest one.
    without = np.setdiff1d(np.flatnonzero(lengths), owners)
    smallest = np.empty(len(without), np.uint64)
    for k, t in enumerate(without.tolist()):
        a, b = int(offsets[t]), int(offsets[t + 1])
        if b - a >= shingle:
            smallest[k] = hashes[a : b - shingle + 1].min()
        else:
            smallest[k] = mix(_windows(data[a:b], b - a) + np.uint64(b - a))[0] >> np.uint64(64 - HASH_BITS)
    kept, owners = np.concatenate([kept, smallest]), np.concatenate([owners, without])
    order = np.lexsort((kept, owners))
    kept, owners = kept[order], owners[order]
    fresh = np.ones(len(kept), bool)
    fresh[1:] = (kept[1:] != kept[:-1]) | (owners[1:] != owners[:-1])
    kept, owners = kept[fresh], owners[fresh]
    return kept, np.searchsorted(owners, np.arange(piece.n + 1))


def _sketch_column(column: pa.Array, shingle: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for _, _, piece in pieces(column):
        kept, offsets = sketches(piece, shingle, scale)
        hashes.append(kept)
        counts.append(np.diff(offsets))
    return np.concatenate(hashes), np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64)


def sketch_texts(df: DataFrame, text: str = "text", keep: Sequence[str] | None = None, shingle: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """Add ``sketch``, the ascending kept hashes of each text."""

    def compute(texts):
        for column in texts:
            hashes, offsets = _sketch_column(column, shingle, scale)
            yield [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(hashes.astype(np.int64)))]

    return add_columns(df, text, compute, [StructField("sketch", ArrayType(LongType()))], keep)


def merged_sketches(sketched: DataFrame, by: Sequence[str], scale: int = SCALE) -> DataFrame:
    """The sketch of each group's union of texts as rows (by, hash): its distinct hashes.

    Counted by Spark with map-side combination, whatever the size of a group.
    """
    threshold = (1 << HASH_BITS) // scale
    hashes = sketched.select(*by, F.explode("sketch").alias("hash"))
    low = hashes.filter(F.col("hash") < threshold).distinct()
    least = hashes.groupBy(*by).agg(F.min("hash").alias("hash")).filter(F.col("hash") >= threshold)
    return low.unionByName(least)


def containment(inner: Column, outer: Column) -> Column:
    """The share of ``inner``'s shingles that ``outer`` has too; of two empty sketches 1."""
    shared = F.size(F.array_intersect(inner, outer)).cast("double")
    return F.when(F.size(inner) > 0, shared / F.size(inner)).otherwise(F.when(F.size(outer) > 0, 0.0).otherwise(1.0))


def likeness(a: Column, b: Column) -> Column:
    """Containment of the smaller sketch in the larger one."""
    return F.when(F.size(a) <= F.size(b), containment(a, b)).otherwise(containment(b, a))


def _alike(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / min(len(a), len(b))


def _packed(hashes: np.ndarray) -> bytes:
    """Hashes as big-endian numbers of six bytes each."""
    return hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - _HASH_BYTES :].tobytes()


def _edited(text: str, successor: str) -> str:
    """The last quarter of ``text`` replaced by as many first code points of its successor."""
    k = len(text) // 4
    return text[: len(text) - k] + successor[:k]


_RESULTS = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


class _Rows:
    """Rows of one partition in order: each is finished when its successor is known."""

    def __init__(self, shingle: int, scale: int):
        self.shingle, self.scale = shingle, scale

    def sketch(self, texts: Sequence[str]) -> list[np.ndarray]:
        hashes, offsets = _sketch_column(pa.array(texts, pa.large_string()), self.shingle, self.scale)
        return [hashes[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]

    def finish(self, texts: Sequence[str], own: Sequence[np.ndarray], after: Sequence[str], next_own: Sequence[np.ndarray]) -> list[list]:
        edited = [_edited(a, b) for a, b in zip(texts, after, strict=True)]
        of_edited = self.sketch(edited)
        return [
            [len(t) for t in texts],
            [hashlib.sha256(e.encode()).hexdigest() for e in edited],
            [_packed(s) for s in own],
            [_packed(s) for s in of_edited],
            [_alike(s, e) for s, e in zip(own, of_edited, strict=True)],
            [_alike(s, e) for s, e in zip(own, next_own, strict=True)],
        ]


def _compress(df: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """The kept columns, an order and the compressed text, which travels at less than half its size."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            data, offsets = text_bytes(batch.column(batch.num_columns - 1))
            raw = memoryview(np.ascontiguousarray(data))
            packed = [pack.compress(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(packed, pa.binary())], names=batch.schema.names)

    source = df.select(*[df[c].alias(f"c{i}") for i, c in enumerate(keep)], F.xxhash64(F.coalesce(df[text], F.lit(""))).alias("h"), df[text].alias("blob"))
    return source.mapInArrow(run, StructType([*source.schema.fields[:-1], StructField("blob", BinaryType())]))


def compare_edited(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    keep: Sequence[str] | None = None,
    shingle: int = SHINGLE,
    scale: int = SCALE,
) -> DataFrame:
    """Fingerprint each text and its edited copy, and compare it with both that copy and its successor.

    Texts are compressed, dealt by ranges of ids and sorted once. A partition's last row waits
    for the first row of the next partition: both are set aside and joined afterwards, one pair
    per partition. ``fingerprint`` and ``edited_fingerprint`` are hexadecimal, twelve digits a hash.
    """
    keep = [c for c in dict.fromkeys([doc_id, *(docs.columns if keep is None else keep)]) if c not in _RESULTS]
    names = [f"c{i}" for i in range(len(keep))]
    laid = _compress(docs, text, keep).repartitionByRange("c0", "h").sortWithinPartitions("c0", "h")
    own_fields = [laid.schema[n] for n in names]
    result = [
        StructField("n_chars", LongType()),
        StructField("edited_sha256", StringType()),
        StructField("fingerprint", BinaryType()),
        StructField("edited_fingerprint", BinaryType()),
        StructField("near_edited", DoubleType()),
        StructField("near_next", DoubleType()),
    ]
    # place: 0 a finished row, 1 the first text of a partition, 2 its last row.
    edge = [StructField("part", IntegerType()), StructField("place", IntegerType()), StructField("blob", BinaryType())]
    schema = StructType([*own_fields, *result, *edge])
    arrow = pa.schema([(f.name, t) for f, t in zip(result, (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()), strict=True)])

    def rows_of(columns: Sequence[pa.Array], results: Sequence[Sequence] | None, part: int, place: int, blobs: Sequence[bytes | None]) -> pa.RecordBatch:
        n = len(blobs)
        made = [pa.nulls(n, f.type) for f in arrow] if results is None else [pa.array(v, f.type) for v, f in zip(results, arrow, strict=True)]
        tail = [pa.array([part] * n, pa.int32()), pa.array([place] * n, pa.int32()), pa.array(blobs, pa.binary())]
        return pa.RecordBatch.from_arrays([*columns, *made, *tail], names=schema.names)

    def read(blobs: pa.Array) -> list[str]:
        unpack = zstandard.ZstdDecompressor()
        return [unpack.decompress(b).decode(errors="replace") for b in blobs.to_pylist()]

    width = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        rows = _Rows(shingle, scale)
        held = None  # the columns, text and sketch of the last row seen
        for batch in batches:
            blobs = batch.column(width + 1)
            sizes = np.array([zstandard.frame_content_size(b) for b in blobs.to_pylist()], np.int64)
            # Batches of about SLICE_BYTES of text, or one longer text.
            for i, j in _runs(sizes, SLICE_BYTES):
                texts = read(blobs.slice(i, j - i))
                own = rows.sketch(texts)
                columns = [c.slice(i, j - i) for c in batch.columns[:width]]
                if held is None:
                    yield rows_of([c.slice(0, 1) for c in columns], None, part, 1, [blobs[i].as_py()])
                else:
                    columns = [pa.concat_arrays([a, b]) for a, b in zip(held[0], columns, strict=True)]
                    texts, own = [held[1], *texts], [held[2], *own]
                if len(texts) > 1:
                    done = rows.finish(texts[:-1], own[:-1], texts[1:], own[1:])
                    yield rows_of([c.slice(0, len(texts) - 1) for c in columns], done, part, 0, [None] * (len(texts) - 1))
                # Copies, so that a held row does not keep its whole batch.
                held = [pa.concat_arrays([c.slice(len(texts) - 1, 1)]) for c in columns], texts[-1], own[-1]
        if held is not None:
            yield rows_of(held[0], None, part, 2, [zstandard.compress(held[1].encode(), 1)])

    made = stored(laid.mapInArrow(run, schema), "fingerprints")
    done = made.filter(F.col("place") == 0).select(*names, *[f.name for f in result])

    # One row per partition that has rows, so this window stays small; the last one's next is the first.
    heads = made.filter(F.col("place") == 1)
    order = W.orderBy("part")
    everywhere = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    follows = heads.select("part").select("part", F.coalesce(F.lead("part").over(order), F.first("part").over(everywhere)).alias("next_part"))
    firsts = heads.select(F.col("part").alias("next_part"), F.col("blob").alias("next_blob"))
    waiting = made.filter(F.col("place") == 2).select(*names, "part", "blob").join(follows, "part").join(firsts, "next_part")
    waiting = waiting.select(*names, "blob", "next_blob")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows(shingle, scale)
        for batch in batches:
            for i in range(batch.num_rows):
                text, after = read(batch.column(width).slice(i, 1)), read(batch.column(width + 1).slice(i, 1))
                results = rows.finish(text, rows.sketch(text), after, rows.sketch(after))
                columns = [c.slice(i, 1) for c in batch.columns[:width]]
                columns += [pa.array(v, f.type) for v, f in zip(results, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *[f.name for f in result]])

    both = done.unionByName(waiting.mapInArrow(close, StructType([*own_fields, *result])))
    texts_of = {"fingerprint", "edited_fingerprint"}
    return both.select(
        *[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)],
        *[F.lower(F.hex(f.name)).alias(f.name) if f.name in texts_of else F.col(f.name) for f in result],
    )


def _runs(sizes: np.ndarray, budget: int) -> Iterator[tuple[int, int]]:
    groups = np.cumsum(sizes) // budget
    starts = group_runs(groups).tolist()
    yield from zip(starts, [*starts[1:], len(sizes)], strict=True) if len(sizes) else ()
