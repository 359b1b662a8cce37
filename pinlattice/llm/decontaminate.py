"""Benchmark decontamination by winnowing.

Of every ``WINDOW`` consecutive words the smallest hash of its ``GRAM``-word runs
is kept as the fingerprint of the window, in benchmark items and documents alike.
Equal windows therefore always share their fingerprint: no shared span of
``WINDOW`` words or more can be missed. Documents and items are joined on
fingerprints, and a hit is extended to the whole window by comparing the window's
own 64-bit hash. Items of fewer words are one window each, their own fingerprint.

Before the join a bit filter of all benchmark fingerprints (a fixed number of
bits) drops windows that cannot match, inside the scan. A full filter drops less
but never loses a hit.

Defined results: null texts have no words and no hits; items without words match
nothing; a null item id marks words but is not listed; repeated items count once;
equal document rows each get the result. Columns named like a new one are
replaced, all others stay.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField

from pinlattice.llm.batches import ALNUM_OR_HIGH, Words, add_columns, mix, pieces, signed

WINDOW = 10
GRAM = 5
FILTER_BITS = 1 << 24


def _fingerprints(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window hash, fingerprint, first word) of every full window."""
    whole, at = words.grams(window)
    if not len(at):
        return whole, whole, at
    grams, start = words.grams(gram)
    dense = np.full(len(words.hashes), np.iinfo(np.uint64).max, np.uint64)
    dense[start] = grams
    smallest = dense[at]
    for k in range(1, window - gram + 1):
        smallest = np.minimum(smallest, dense[at + k])
    return whole, smallest, at


def benchmark_windows(items: DataFrame, item_id: str, text: str, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Distinct rows (fp, window hash, n words, item) of all items."""
    source = items.select(items[item_id].cast("string").alias("item"), items[text].alias("text"))

    def run(batches):
        for batch in batches:
            for i, j, piece in pieces(batch.column(1)):
                words = Words(piece, ALNUM_OR_HIGH, True)
                whole, smallest, at = _fingerprints(words, window, gram)
                parts = [(smallest, whole, np.full(len(at), window), words.text[at])]
                for n in range(1, window):
                    runs, first = words.grams(n)
                    short = words.counts[words.text[first]] == n
                    parts.append((runs[short], runs[short], np.full(int(short.sum()), n), words.text[first[short]]))
                fp, win, size, owner = (np.concatenate(x) for x in zip(*parts, strict=True))
                item = batch.column(0).slice(i, j - i).take(pa.array(owner))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(fp)), pa.array(signed(win)), pa.array(size.astype(np.int32)), item], names=["fp", "win", "size", "item"]
                )

    return source.mapInArrow(run, "fp long, win long, size int, item string").distinct()


def bit_filter(keys: DataFrame, column: str, bits: int = FILTER_BITS) -> np.ndarray:
    """A filter of the 64-bit keys, one bit each; ``bits`` (a power of two) bounds its size."""
    words = bits // 64
    slot = F.col(column).bitwiseAND(F.lit(bits - 1))
    rows = (
        keys.select(F.shiftright(slot, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
        .toArrow()  # at most bits / 64 rows
    )
    out = np.zeros(words, np.int64)
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return out.view(np.uint64)


def passes(filter_words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys & np.uint64(len(filter_words) * 64 - 1)
    return (filter_words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) != 0


def _lists(values: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    """Values, sorted by owner, as one list per owner."""
    offsets = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def candidate_windows(docs: DataFrame, text: str, keep: Sequence[str], bits: np.ndarray, short: Sequence[int], window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Each document with ``n_words`` and its windows that may match: fps, wins, starts, sizes."""

    def compute(texts):
        for column in texts:
            counts, out = [], []
            for _, _, piece in pieces(column):
                words = Words(piece, ALNUM_OR_HIGH, True)
                whole, smallest, at = _fingerprints(words, window, gram)
                parts = [(smallest, whole, at, np.full(len(at), window))]
                for n in short:
                    runs, first = words.grams(n)
                    parts.append((runs, runs, first, np.full(len(first), n)))
                fp, win, start, size = (np.concatenate(x) for x in zip(*parts, strict=True))
                may = passes(bits, fp)
                fp, win, start, size = fp[may], win[may], start[may], size[may]
                owner = words.text[start]
                order = np.argsort(owner, kind="stable")
                owner = owner[order]
                local = start[order] - words.bounds[owner]
                counts.append(words.counts)
                out.append([_lists(x, owner, piece.n) for x in (signed(fp[order]), signed(win[order]), local, size[order].astype(np.int64))])
            lists = [pa.concat_arrays(x) for x in zip(*out, strict=True)] if out else [pa.array([], pa.list_(pa.int64()))] * 4
            yield [np.concatenate(counts).astype(np.int64) if counts else np.zeros(0, np.int64), *lists]

    fields = [StructField("n_words", LongType()), *[StructField(n, ArrayType(LongType())) for n in ("fps", "wins", "starts", "sizes")]]
    return add_columns(docs, text, compute, fields, keep)


def _covered(spans: F.Column) -> F.Column:
    """Words inside the union of sorted (start, size) spans."""
    step = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("end")),
        lambda acc, s: F.struct(
            (acc["total"] + F.greatest(F.lit(0).cast("long"), s["start"] + s["size"] - F.greatest(acc["end"], s["start"]))).alias("total"),
            F.greatest(acc["end"], s["start"] + s["size"]).alias("end"),
        ),
    )
    return step["total"]


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
) -> DataFrame:
    """One row per distinct (id, text): n_words, n_hit, hit spans (start, size in words) and sorted item ids.

    ``text_key`` is the 64-bit hash of the text; with the id it names the row.
    """
    windows = benchmark_windows(items, item_id, item_text, window, gram)
    bits = bit_filter(windows, "fp")
    # At most window - 1 distinct sizes.
    short = [r[0] for r in windows.select("size").distinct().collect() if r[0] < window]
    source = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("__body"), F.xxhash64(docs[text]).alias("text_key"))
    found = candidate_windows(source, "__body", ["doc_id", "text_key"], bits, sorted(short), window, gram)
    rows = found.select(
        "doc_id", "text_key", "n_words", F.explode_outer(F.arrays_zip("fps", "wins", "starts", "sizes")).alias("w")
    ).select(
        "doc_id",
        "text_key",
        "n_words",
        # Rows without a window get a key of their own, so they do not meet in one task; win stays null.
        F.coalesce(F.col("w.fps"), F.xxhash64("doc_id", "text_key")).alias("fp"),
        F.col("w.wins").alias("win"),
        F.col("w.starts").alias("start"),
        F.col("w.sizes").alias("size"),
    )
    bench = windows.withColumnRenamed("size", "item_size")
    hits = rows.join(bench, (rows["fp"] == bench["fp"]) & (rows["win"] == bench["win"]) & (rows["size"] == bench["item_size"]), "left")
    hit = F.col("item_size").isNotNull()
    grouped = hits.groupBy("doc_id", "text_key").agg(
        F.max("n_words").alias("n_words"),
        F.collect_set(F.when(hit, F.struct("start", "size"))).alias("spans"),
        F.collect_set("item").alias("items"),
    )
    return grouped.select(
        "doc_id",
        "text_key",
        "n_words",
        F.array_sort("spans").alias("spans"),
        _covered(F.array_sort("spans")).alias("n_hit"),
        F.array_sort("items").alias("items"),
    )


def mark_documents(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """All rows and columns of ``docs`` plus n_words, n_hit, items and ``contaminated``."""
    found = find_contamination(docs, items, doc_id, text, **options)
    found = found.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "n_words", "n_hit", "items")
    new = ("n_words", "n_hit", "items", "contaminated")
    left = docs.select(*[docs[c] for c in docs.columns if c not in new or c in (doc_id, text)], F.xxhash64(docs[text]).alias("__text_key"))
    joined = left.join(found, left[doc_id].eqNullSafe(found["__id"]) & (left["__text_key"] == found["__key"]), "left")
    return joined.drop("__text_key", "__id", "__key").withColumn("contaminated", F.col("n_hit") > 0)
