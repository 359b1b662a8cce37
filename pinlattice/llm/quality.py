"""Quality rules: surface statistics, then a hashed n-gram log-likelihood ratio.

Two multinomials over hashed unigrams and bigrams are counted over all rows: one
over the trusted target, one over the raw corpus. A document's score is the mean,
over its n-grams, of log(target share) - log(raw share); one fixed threshold
decides every document. Both models are arrays of ``buckets`` numbers, whatever
the corpus is, so they are small enough to travel with the tasks.

Defined results: null and empty texts have no words, score 0 and fail the base
rules (under 50 words). Without any trusted row both models are equal, every
score is 0 and only the base rules decide. Equal rows get equal verdicts. Columns
named like a new one are replaced, all others stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from pinlattice.llm.batches import NOT_SPACE, Piece, Words, add_columns, byte_class, group_runs, mix, pieces, span_hashes

BUCKETS = 1 << 14
SMOOTHING = 1.0
# Nats per n-gram below which a text is unlike the trusted target.
THRESHOLD = -0.2
MIN_WORDS = 50

_SYMBOL = byte_class(lambda b: chr(b) in "#*$%&|<>")
_CODE_POINT = byte_class(lambda b: (b & 0xC0) != 0x80)
_NEWLINE = byte_class(lambda b: b == 10)


def gram_buckets(words: Words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every unigram and bigram."""
    pairs, at = words.grams(2)
    keys = np.concatenate([mix(words.hashes), pairs])
    return (keys % np.uint64(buckets)).astype(np.int64), np.concatenate([words.text, words.text[at]])


def target_counts(df: DataFrame, text: str, trusted: str, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(raw, target) n-gram counts over all rows; ``trusted`` is a boolean column (null: false)."""
    source = df.select(df[text].alias("text"), F.coalesce(df[trusted], F.lit(False)).alias("trusted"))

    def count(batches):
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            good = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for i, _, piece in pieces(batch.column(0)):
                bucket, at = gram_buckets(Words(piece, NOT_SPACE, False), buckets)
                raw += np.bincount(bucket, minlength=buckets)
                target += np.bincount(bucket[good[i + at]], minlength=buckets)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (used, raw[used], target[used])], names=["bucket", "raw", "target"])

    counts = (
        source.mapInArrow(count, "bucket long, raw long, target long")
        .groupBy("bucket")
        .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
        .collect()  # at most one row per bucket
    )
    raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for bucket, r, t in counts:
        raw[bucket], target[bucket] = r, t
    return raw, target


def log_ratio(raw: np.ndarray, target: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """log(target share) - log(raw share) per bucket.

    The target gets ``smoothing`` pseudo-counts per bucket on average, spread like
    the raw corpus, so a small target says little and none says nothing (zeros).
    """
    share = raw / max(raw.sum(), 1)
    prior = smoothing * len(raw)
    mixed = (target + prior * share) / (target.sum() + prior)
    return np.where(raw > 0, np.log(np.where(raw > 0, mixed, 1.0)) - np.log(np.where(raw > 0, share, 1.0)), 0.0)


def repeated_words(words: Words, n: int = 3) -> np.ndarray:
    """Per text, the words inside windows of ``n`` words that occur twice or more in it."""
    grams, at = words.grams(n)
    keys = mix(grams + mix(words.text[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys)
    runs = group_runs(keys[order])
    sizes = np.diff(np.append(runs, len(keys)))
    twice = at[order[np.repeat(sizes > 1, sizes)]]
    covered = np.zeros(len(words.hashes), bool)
    for k in range(n):
        covered[twice + k] = True
    return np.bincount(words.text[covered], minlength=words.piece.n)


def duplicate_lines(piece: Piece, flags: np.ndarray) -> np.ndarray:
    """Per text, the lines with a word that equal an earlier line of it."""
    data, offsets = piece.data, piece.offsets
    line_breaks = np.flatnonzero(_NEWLINE[data])
    filled = np.diff(offsets) > 0
    begins = np.concatenate([offsets[:-1][filled], line_breaks + 1])
    begins = np.unique(begins[begins < len(data)])
    owner = np.searchsorted(offsets, begins, "right") - 1
    ends = np.minimum(np.append(begins[1:], len(data)), offsets[owner + 1])
    # A line ends before its line break.
    ends = ends - _NEWLINE[data[ends - 1]] if len(ends) else ends
    seen = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=seen[1:])
    worded = seen[ends] > seen[begins]
    owner = owner[worded]
    keys = mix(span_hashes(data, begins[worded], ends[worded]) + mix(owner.astype(np.uint64) + np.uint64(1)))
    _, first = np.unique(keys, return_index=True)
    return np.bincount(owner, minlength=piece.n) - np.bincount(owner[first], minlength=piece.n)


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(
    df: DataFrame,
    text: str,
    weights: np.ndarray,
    threshold: float = THRESHOLD,
    keep: list[str] | None = None,
) -> DataFrame:
    """Add the counts, ``base_failed``, ``llr`` (mean log ratio) and ``kept`` to every row."""
    buckets = len(weights)

    def compute(texts):
        for column in texts:
            parts = []
            for _, _, piece in pieces(column):
                words = Words(piece, NOT_SPACE, False)
                bucket, at = gram_buckets(words, buckets)
                total = np.bincount(at, weights[bucket], minlength=piece.n)
                score = total / np.maximum(np.bincount(at, minlength=piece.n), 1)
                parts.append(
                    (
                        words.counts,
                        piece.per_text(words.flags & _CODE_POINT[piece.data]),
                        piece.per_text(_SYMBOL[piece.data]),
                        duplicate_lines(piece, words.flags),
                        repeated_words(words),
                        score,
                    )
                )
            joined = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 5 + [np.zeros(0)]
            n_words, repeats, score = joined[0], joined[4], joined[5]
            failed = (n_words < MIN_WORDS) | (100 * repeats > 50 * n_words)
            yield [*[x.astype(np.int64) for x in joined[:5]], failed, score, ~failed & (score >= threshold)]

    fields = [StructField(n, LongType()) for n in _COUNTS]
    fields += [StructField("base_failed", BooleanType()), StructField("llr", DoubleType()), StructField("kept", BooleanType())]
    return add_columns(df, text, compute, fields, keep)


def trusted_rows(docs: DataFrame, labels: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Texts with a ``trusted`` flag: some label of the document has quality 1.

    One plan at every size: both sides are shuffled by id, labels are never
    broadcast, and adaptive execution splits a hot id of the left side.
    """
    good = labels.filter(F.col("quality") == 1).select(F.col("doc_id").alias("__id")).distinct()
    left = docs.select(docs[doc_id].alias("__doc"), docs[text].alias("text"))
    return left.join(good.hint("shuffle_merge"), left["__doc"] == good["__id"], "left").select("text", F.col("__id").isNotNull().alias("trusted"))


def quality_rules(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Train both multinomials on all rows and judge every document."""
    raw, target = target_counts(trusted_rows(docs, labels, doc_id, text), "text", "trusted")
    return judge(docs, text, log_ratio(raw, target), keep=keep)
