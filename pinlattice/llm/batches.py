"""Arrow batches inside tasks: cut them into bounded pieces and hash words without a Python loop.

A task sees Arrow batches of rows. ``pieces`` cuts a batch into runs of rows of a
few megabytes, so arrays built per byte stay small; only a single longer text
makes a larger piece. ``Words`` finds the words of all texts of a piece at once
and gives each a 64-bit hash. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

PIECE_BYTES = 2 << 20
SLICE_BYTES = 8 << 20
_BLOCK = 1 << 18
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scrambler (the SplitMix64 finalizer)."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_class(inside: Callable[[int], bool]) -> np.ndarray:
    """A table over the 256 byte values."""
    return np.array([inside(b) for b in range(256)], bool)


# Bytes of UTF-8 outside ASCII are never white space or punctuation of ASCII.
NOT_SPACE = byte_class(lambda b: not (b == 0x20 or 9 <= b <= 13))
ALNUM_OR_HIGH = byte_class(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)


def _powers(base: int) -> np.ndarray:
    steps = np.full(_BLOCK, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


_POW, _INV = _powers(_BASE), _powers(_BASE_INVERSE)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of ``data``; spans are sorted and do not overlap."""
    out = np.empty(len(starts), np.uint64)
    codes = _BYTE_CODE[data]
    i = 0
    while i < len(starts):
        first = starts[i]
        j = int(np.searchsorted(ends, first + _BLOCK, "right"))
        if j <= i:  # one span longer than a block: add up its blocks
            total, weight = np.uint64(0), np.uint64(1)
            for at in range(int(first), int(ends[i]), _BLOCK):
                part = codes[at : min(at + _BLOCK, ends[i])]
                with np.errstate(over="ignore"):
                    total = total + weight * np.sum(part * _POW[: len(part)], dtype=np.uint64)
                    weight = weight * np.uint64(pow(_BASE, _BLOCK, 1 << 64))
            out[i] = total
            i += 1
            continue
        last = ends[j - 1]
        sums = np.zeros(last - first + 1, np.uint64)
        np.cumsum(codes[first:last] * _POW[: last - first], out=sums[1:])
        s = starts[i:j] - first
        # An empty span has no first byte, its hash is 0 whatever the factor is.
        out[i:j] = (sums[ends[i:j] - first] - sums[s]) * _INV[np.minimum(s, _BLOCK - 1)]
        i = j
    return mix(out + (ends - starts).astype(np.uint64) * _STEP)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The joined UTF-8 bytes of a string column and its n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_binary()) if pa.types.is_binary(column.type) else column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def cuts(offsets: np.ndarray, budget: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``budget`` bytes, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + budget, "right")) - 1)
        yield i, j
        i = j


class Piece:
    """The texts of a run of rows as bytes: ``data`` and ``offsets``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.n = len(offsets) - 1

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many of the flagged bytes each text has."""
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return np.diff(sums[self.offsets])


class Words:
    """The words of all texts of a piece: maximal runs of bytes in ``inside``."""

    def __init__(self, piece: Piece, inside: np.ndarray, lower: bool):
        self.piece = piece
        self.data = _LOWER[piece.data] if lower else piece.data
        flags = inside[self.data]
        edges = np.unique(piece.offsets[:-1])
        edges = edges[edges < len(flags)]
        opens, closes = flags.copy(), flags.copy()
        opens[1:] &= ~flags[:-1]
        opens[edges] = flags[edges]
        closes[:-1] &= ~flags[1:]
        before = edges[edges > 0] - 1
        closes[before] = flags[before]
        self.flags = flags
        self.starts = np.flatnonzero(opens)
        self.ends = np.flatnonzero(closes) + 1
        self.hashes = span_hashes(self.data, self.starts, self.ends)
        self.bounds = np.searchsorted(self.starts, piece.offsets)
        self.counts = np.diff(self.bounds)
        self.text = np.repeat(np.arange(piece.n), self.counts)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every run of n words of one text, and the index of its first word."""
        h = self.hashes
        if len(h) < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        m = len(h) - n + 1
        out = np.zeros(m, np.uint64)
        for k in range(n):
            out = out * np.uint64(_BASE) + h[k : k + m]
        whole = self.text[:m] == self.text[n - 1 :]
        return mix(out[whole] + np.uint64(n)), np.flatnonzero(whole)

    def bytes_of(self, index: np.ndarray) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.starts[index].tolist(), self.ends[index].tolist(), strict=True)]


def pieces(column: pa.Array | pa.ChunkedArray, budget: int = PIECE_BYTES) -> Iterator[tuple[int, int, Piece]]:
    """(first row, end row, piece) over a string column."""
    data, offsets = text_bytes(column)
    for i, j in cuts(offsets, budget):
        yield i, j, Piece(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def group_runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Start of every run of equal keys."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned hashes as Spark's bigint."""
    return x.view(np.int64)


def sliced(batches: Iterable[pa.RecordBatch], text: int, budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that none has more than ``budget`` bytes of text, or a single longer text."""
    for batch in batches:
        # Lengths only: no copy of the texts is made for cutting.
        lengths = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        for i, j in cuts(np.concatenate(([0], np.cumsum(lengths, dtype=np.int64))), budget):
            yield batch.slice(i, j - i)


def add_columns(
    df: DataFrame,
    text: str,
    compute: Callable[[Iterator[pa.Array]], Iterator[Sequence]],
    fields: Sequence[StructField],
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """``df`` with columns computed from the text of each row, in one pass without a shuffle.

    ``compute`` gets the text column of each Arrow batch in turn and yields the new
    columns for it. ``keep`` names the columns that stay (all by default); one with
    the name of a new column is replaced.
    """
    new = [f.name for f in fields]
    keep = [c for c in (df.columns if keep is None else keep) if c not in new]
    source = df.select(*[df[c] for c in keep], df[text].alias("__text"))
    schema = StructType([*[source.schema[c] for c in keep], *fields])
    width = len(keep)

    def run(batches):
        held = []

        def texts():
            for batch in sliced(batches, width):
                held.append(batch)
                yield batch.column(width)

        for values in compute(texts()):
            batch = held.pop()
            columns = [*batch.columns[:width], *values]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=[*keep, *new])

    return source.mapInArrow(run, schema)
