"""Toxicity by weak supervision.

Voters are lexicon entries (words) and patterns (word beginnings) that occur in
toxic documents far more often than in others; a label of the ``labels`` table is
one more voter. A generative model estimates by expectation maximization how often
each voter fires on either class, and from the conditional correlations of the
voters how much of its evidence is its own. The posterior of every sample row is
the (soft) label for a logistic regression on the presence of the same kinds of
features, which scores every text.

Everything is learned from about ``SAMPLE`` labelled rows of the training fold,
chosen by a hash of the id; at most ``FEATURES`` features and ``VOTERS`` voters
are kept, so the learned state has a fixed bound. Every text is scored whole.

Defined results: null and empty texts have no feature and get the score of the
bias alone; conflicting labels of an id count as toxic; without labelled rows of
both classes every score is the share of toxic labels (0 without labels). Columns
named like a new one are replaced, all others stay.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField

from pinlattice.llm.batches import add_columns, sliced
from pinlattice.llm.language import indexed_words

SAMPLE = 20_000
FEATURES = 4096
VOTERS = 256
# A voter fires on at least so many toxic sample rows, and so much of its firing is on them.
MIN_SUPPORT = 5
MIN_PRECISION = 0.7
# Features whose rates on the two classes are so many standard errors apart are used.
SIGNIFICANT = 5.0
# Correlations of voters within a class above this count as repetition.
CORRELATED = 0.3
PREFIXES = (4, 5, 6)
THRESHOLD = 0.3

_LETTERS = re.compile(r"[^\W\d_]+")


def features_of(word: str) -> list[str]:
    """Lexicon and pattern features of one lower-cased word."""
    out = []
    for run in _LETTERS.findall(word):
        out.append("w:" + run)
        out += [f"p:{run[:n]}" for n in PREFIXES if len(run) > n]
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, size: int = SAMPLE) -> DataFrame:
    """About ``size`` rows (text, toxic) whose id has a label."""
    marks = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    every = max(1, marks.count() // size)
    # A hash picks about ``size`` ids; the limit is what makes the broadcast safe.
    chosen = marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).limit(2 * size)
    chosen = F.broadcast(chosen.withColumnRenamed("doc_id", "__id"))
    return docs.join(chosen, docs[doc_id] == F.col("__id")).select(docs[text].alias("text"), "toxic")


def feature_counts(sample: DataFrame) -> DataFrame:
    """(feature, toxic, clean): rows of each class that have the feature."""

    def run(batches):
        for batch in sliced(batches, 0):
            words, parts = indexed_words(batch.column(0))
            toxic = batch.column(1).to_numpy() > 0
            index: dict[str, int] = {}
            owned = [[index.setdefault(f, len(index)) for f in features_of(w)] for w in words]
            sizes = np.fromiter(map(len, owned), np.int64, len(owned))
            flat = np.fromiter((f for fs in owned for f in fs), np.int64, int(sizes.sum()))
            first = np.cumsum(sizes) - sizes
            counts = np.zeros((2, len(index)), np.int64)
            for i, _, row, word in parts:
                pairs = _expand(row, word, flat, first, sizes, len(index))
                counts[1] += np.bincount(pairs[1][toxic[i + pairs[0]]], minlength=len(index))
                counts[0] += np.bincount(pairs[1][~toxic[i + pairs[0]]], minlength=len(index))
            yield pa.RecordBatch.from_arrays([pa.array(list(index), pa.string()), pa.array(counts[1]), pa.array(counts[0])], names=["feature", "toxic", "clean"])

    counted = sample.mapInArrow(run, "feature string, toxic long, clean long")
    return counted.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _expand(row: np.ndarray, word: np.ndarray, flat: np.ndarray, first: np.ndarray, sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) of the words of some rows."""
    pairs = np.unique(row.astype(np.int64) * (len(sizes) + 1) + word)
    row, word = pairs // (len(sizes) + 1), pairs % (len(sizes) + 1)
    use = sizes[word] > 0
    row, word = row[use], word[use]
    n_of = sizes[word]
    at = np.repeat(first[word] - (np.cumsum(n_of) - n_of), n_of) + np.arange(int(n_of.sum()))
    keys = np.unique(np.repeat(row, n_of) * max(n, 1) + flat[at])
    return keys // max(n, 1), keys % max(n, 1)


@dataclass
class LabelModel:
    """Rates of each voter on toxic and clean rows, and the share of its evidence that is its own."""

    prior: float
    on_toxic: np.ndarray
    on_clean: np.ndarray
    own: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        yes = np.log(self.on_toxic) - np.log(self.on_clean)
        no = np.log1p(-self.on_toxic) - np.log1p(-self.on_clean)
        evidence = votes @ (self.own * (yes - no)) + (self.own * no).sum()
        return 1 / (1 + np.exp(-np.clip(evidence + np.log(self.prior / (1 - self.prior)), -30, 30)))


def own_evidence(votes: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Share of each voter's evidence that other voters do not repeat, from correlations within each class."""
    excess = np.zeros((votes.shape[1], votes.shape[1]))
    for rows in (votes[toxic], votes[~toxic]):
        if len(rows) < 2:
            continue
        rate = (rows.sum(axis=0) + 0.5) / (len(rows) + 1)
        spread = np.sqrt(rate * (1 - rate))
        correlation = (rows.T @ rows / len(rows) - np.outer(rate, rate)) / np.outer(spread, spread)
        # Voters that hardly fire on a class tell nothing about how they hang together there.
        fires = rows.sum(axis=0) >= MIN_SUPPORT
        excess = np.maximum(excess, np.where(np.outer(fires, fires), correlation, 0))
    np.fill_diagonal(excess, 0)
    # A voter that repeats k others counts about one k-th.
    return 1 / (1 + np.where(excess > CORRELATED, excess, 0).sum(axis=1))


def fit_label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 25) -> LabelModel:
    """Expectation maximization over the voters' rates from starting posteriors."""
    votes = votes.astype(np.float64)
    own = own_evidence(votes, start >= 0.5)
    p, model = start.astype(np.float64), None
    for _ in range(rounds):
        prior = float(np.clip(p.mean(), 0.005, 0.5))
        on_toxic = (p @ votes + 0.5) / (p.sum() + 1)
        on_clean = ((1 - p) @ votes + 0.5) / ((1 - p).sum() + 1)
        model = LabelModel(prior, on_toxic, on_clean, own)
        p = model.posterior(votes)
    return model


@dataclass
class Scorer:
    features: list[str]
    weights: np.ndarray
    bias: float

    def __call__(self, column: pa.Array) -> np.ndarray:
        index = {f: i for i, f in enumerate(self.features)}
        words, parts = indexed_words(column)
        owned = [[index[f] for f in features_of(w) if f in index] for w in words]
        sizes = np.fromiter(map(len, owned), np.int64, len(owned))
        flat = np.fromiter((f for fs in owned for f in fs), np.int64, int(sizes.sum()))
        first = np.cumsum(sizes) - sizes
        total = np.full(len(column), self.bias)
        for i, rows, row, word in parts:
            at, feature = _expand(row, word, flat, first, sizes, len(index))
            total[i : i + rows] += np.bincount(at, self.weights[feature], minlength=rows)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit_linear(rows: np.ndarray, features: np.ndarray, target: np.ndarray, n: int, ridge: float = 1.0, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse presence features and soft targets, by accelerated gradient steps."""
    weight, bias = np.zeros(n), float(np.log(target.mean() / (1 - target.mean())))
    count = np.bincount(features, minlength=n)
    # Each feature has its own step, for the curvature of its column and the widest row.
    widest = max(1, int(np.bincount(rows, minlength=len(target)).max(initial=1)))
    step = 1 / (0.25 * count * min(widest, 30) + ridge)
    ahead, last = weight.copy(), weight.copy()
    for t in range(1, rounds + 1):
        score = bias + np.bincount(rows, ahead[features], minlength=len(target))
        error = target - 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        weight = ahead + step * (np.bincount(features, error[rows], minlength=n) - ridge * ahead)
        bias += error.sum() / (0.25 * len(target)) / 4
        ahead = weight + (t - 1) / (t + 2) * (weight - last)
        last = weight
    return weight, float(bias)


def train(sample: DataFrame, features: int = FEATURES, voters: int = VOTERS) -> Scorer:
    """The scorer learned from rows (text, toxic)."""
    sample = sample.persist()
    try:
        toxic, rows = sample.agg(F.sum((F.col("toxic") > 0).cast("long")), F.count(F.lit(1))).first()
        toxic = toxic or 0
        if not 0 < toxic < rows:
            share = float(np.clip(toxic / rows if rows else 0.0, 1e-9, 1 - 1e-9))
            return Scorer([], np.zeros(0), float(np.log(share / (1 - share))))
        # Ranked by how far the rates of the two classes are apart, against their noise.
        a, b = F.col("toxic") / F.lit(toxic), F.col("clean") / F.lit(rows - toxic)
        rank = F.abs(a - b) / F.sqrt((F.col("toxic") + F.col("clean") + 1) / F.lit(rows) * F.lit(1 / toxic + 1 / (rows - toxic)))
        seen = feature_counts(sample).filter(F.col("toxic") + F.col("clean") >= MIN_SUPPORT).withColumn("rank", rank)
        kept = seen.filter(F.col("rank") >= SIGNIFICANT).orderBy(F.desc("rank"), "feature").limit(features).collect()
        names = [r["feature"] for r in kept]
        index = {f: i for i, f in enumerate(names)}

        def hits(batches):
            for batch in sliced(batches, 0):
                words, parts = indexed_words(batch.column(0))
                owned = [[index[f] for f in features_of(w) if f in index] for w in words]
                sizes = np.fromiter(map(len, owned), np.int64, len(owned))
                flat = np.fromiter((f for fs in owned for f in fs), np.int64, int(sizes.sum()))
                lists = [pa.array([], pa.list_(pa.int32()))]
                for _, n, row, word in parts:
                    at, feature = _expand(row, word, flat, np.cumsum(sizes) - sizes, sizes, len(index))
                    offsets = np.searchsorted(at, np.arange(n + 1)).astype(np.int32)
                    lists.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(feature.astype(np.int32))))
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(lists), batch.column(1)], names=["hits", "toxic"])

        found = sample.mapInArrow(hits, "hits array<int>, toxic int").toArrow()  # at most 2 * SAMPLE rows
    finally:
        sample.unpersist()
    lists = found.column("hits").to_pylist()
    label = (found.column("toxic").to_numpy() > 0).astype(float)
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    row = np.repeat(np.arange(len(lists)), sizes)
    feature = np.fromiter((f for x in lists for f in x), np.int64, int(sizes.sum()))
    voting = [i for i, r in enumerate(kept) if r["toxic"] >= MIN_SUPPORT and r["toxic"] >= MIN_PRECISION * (r["toxic"] + r["clean"])][:voters]
    place = np.full(len(names), -1)
    place[voting] = np.arange(len(voting))
    votes = np.zeros((len(lists), len(voting) + 1))
    chosen = place[feature] >= 0
    votes[row[chosen], place[feature[chosen]]] = 1
    votes[:, -1] = label
    start = np.where(label > 0, 0.9, np.where(votes[:, :-1].any(axis=1), 0.2, 0.02))
    posterior = fit_label_model(votes, start).posterior(votes)
    weights, bias = fit_linear(row, feature, np.clip(posterior, 1e-4, 1 - 1e-4), len(names))
    return Scorer(names, weights, bias)


def score_texts(docs: DataFrame, scorer: Scorer, text: str = "text", threshold: float = THRESHOLD, keep: Sequence[str] | None = None) -> DataFrame:
    """Add ``score`` (probability of toxic) and ``predicted``."""

    def compute(texts):
        for column in texts:
            score = scorer(column)
            yield [score, (score >= threshold).astype(np.int32)]

    return add_columns(docs, text, compute, [StructField("score", DoubleType()), StructField("predicted", IntegerType())], keep)
