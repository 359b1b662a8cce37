"""Language identification by interpolated Kneser-Ney character models.

Characters of a word are predicted from up to ``ORDER`` - 1 characters before
them in the word (its edges included), one model per language. The highest order
uses counts, lower orders the number of distinct characters seen before
(continuation counts), all with absolute discounting and interpolation down to a
uniform distribution. All models share sorted arrays of 64-bit n-gram hashes with
one column of probabilities per language. A text gets the language of the lowest
cross-entropy per character.

Counts cover all training rows. An n-gram stays when its count reaches the
language's characters / ``GRAMS``, the same relative floor at every size, which
bounds each language's model to ``GRAMS`` entries per order. A word costs the same
wherever it stands, so a task scores each distinct word of a batch once.

The confidence is calibrated: the gap per character between the two best
languages, through a logistic curve fitted on about ``CALIBRATION`` labelled
training rows (chosen by a hash of the row); ``rejected`` marks scores under
``REJECT``.

Defined results: a null text, one without a letter, and any text when nothing was
learned, is ``und`` with score 0; equal costs go to the first language by name;
with a single learned language the score is 1. Columns named like a new one are
replaced, all others stay.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField

from pinlattice.llm.batches import NOT_SPACE, Words, add_columns, mix, pieces, sliced
from pinlattice.session import materialize

ORDER = 4
GRAMS = 1 << 17
DISCOUNT = 0.75
CALIBRATION = 4000
REJECT = 0.5
UNKNOWN = "und"
_ALPHABET = 1 << 17
_BASE = np.uint64(0x9E3779B97F4A7C15)


def indexed_words(column: pa.Array) -> tuple[list[str], list[tuple[int, int, np.ndarray, np.ndarray]]]:
    """Distinct lower-cased words of a batch, and (first row, rows, row of each word, word index) per piece."""
    index: dict[int, int] = {}
    names: list[str] = []
    parts = []
    for i, j, piece in pieces(column):
        words = Words(piece, NOT_SPACE, True)
        hashes, first, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
        fresh = np.array([h not in index for h in hashes.tolist()], bool)
        for h, raw in zip(hashes[fresh].tolist(), words.bytes_of(first[fresh]), strict=True):
            index[h] = len(names)
            names.append(raw.decode().lower())
        place = np.array([index[h] for h in hashes.tolist()], np.int32)
        parts.append((i, j - i, words.text.astype(np.int32), place[inverse]))
    return names, parts


def char_grams(words: Sequence[str], order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(hashes of the 1..order-grams that end at each character, word, place); edges are characters too."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    text = " " + "  ".join(words) + " " if len(words) else ""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    owner = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = []
    for k in range(1, order + 1):
        h = np.zeros(len(codes), np.uint64)
        for back in range(k - 1, -1, -1):
            shifted = np.roll(codes, back)
            h = mix(h * _BASE + shifted)
        out.append(mix(h + np.uint64(k)))
    return out, owner, place


def gram_counts(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, k, gram, context, suffix, n) of all rows (lang, text)."""

    def run(batches):
        for batch in sliced(batches, 1):
            langs = batch.column(0).dictionary_encode()
            codes = langs.indices.to_numpy(zero_copy_only=False)
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                names, parts = indexed_words(batch.column(1).filter(pa.array(codes == code)))
                weight = np.zeros(len(names), np.int64)
                for *_, word in parts:
                    weight += np.bincount(word, minlength=len(names))
                hashes, owner, place = char_grams(names, order)
                for k in range(1, order + 1):
                    at = np.flatnonzero(place >= max(1, k - 1))
                    gram, first, inverse = np.unique(hashes[k - 1][at], return_index=True, return_inverse=True)
                    n = np.bincount(inverse, weight[owner[at]], minlength=len(gram)).astype(np.int64)
                    at = at[first]
                    context = hashes[k - 2][at - 1] if k > 1 else np.zeros(len(at), np.uint64)
                    suffix = hashes[k - 2][at] if k > 1 else np.zeros(len(at), np.uint64)
                    columns = [pa.array([lang] * len(at), pa.string()), pa.array(np.full(len(at), k, np.int32))]
                    columns += [pa.array(x.view(np.int64)) for x in (gram, context, suffix)] + [pa.array(n)]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "k", "gram", "context", "suffix", "n"])

    counted = rows.mapInArrow(run, "lang string, k int, gram long, context long, suffix long, n long")
    return counted.groupBy("lang", "k", "gram").agg(F.first("context").alias("context"), F.first("suffix").alias("suffix"), F.sum("n").alias("n"))


@dataclass
class Models:
    """Per order: sorted n-gram hashes with probabilities, sorted contexts with back-off weights; a column per language."""

    langs: list[str]
    grams: list[np.ndarray]
    probability: list[np.ndarray]
    contexts: list[np.ndarray]
    weight: list[np.ndarray]
    # Logistic curve of the gap per character.
    intercept: float = 0.0
    slope: float = 0.0

    def log_probability(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log probability per word and language, coded characters per word)."""
        order = len(self.grams)
        hashes, owner, place = char_grams(words, order)
        coded = np.flatnonzero(place >= 1)
        total = np.zeros((len(coded), len(self.langs)))
        open_ = np.ones(len(coded), bool)
        for k in range(order, 0, -1):
            at = np.flatnonzero(open_ & (place[coded] >= k - 1))
            if not len(at):
                continue
            where, hit = _find(self.grams[k - 1], hashes[k - 1][coded[at]])
            total[at[hit]] += np.log(self.probability[k - 1][where[hit]])
            open_[at[hit]] = False
            at = at[~hit]
            if k > 1:
                where, known = _find(self.contexts[k - 1], hashes[k - 2][coded[at] - 1])
                total[at[known]] += np.log(self.weight[k - 1][where[known]])
            else:
                total[at] += np.log(self.weight[0][0] / _ALPHABET)
        out = np.stack([np.bincount(owner[coded], total[:, i], minlength=len(words)) for i in range(len(self.langs))], axis=1)
        return out, np.bincount(owner[coded], minlength=len(words))


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    where = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return where, table[where] == keys


def train(rows: DataFrame, order: int = ORDER, grams: int = GRAMS, discount: float = DISCOUNT) -> Models:
    """Models of all rows (lang, text); lang is not null."""
    counts = materialize(gram_counts(rows, order))
    totals = counts.filter("k = 1").groupBy("lang").agg(F.sum("n").alias("total"))
    kept = counts.join(totals, "lang").filter(F.col("n") * grams >= F.col("total")).drop("total").toArrow()
    langs = sorted(set(kept.column("lang").to_pylist()))
    code = {lang: i for i, lang in enumerate(langs)}
    which = np.array([code[x] for x in kept.column("lang").to_pylist()], np.int64)
    level, count = kept.column("k").to_numpy(), kept.column("n").to_numpy()
    gram, context, suffix = (kept.column(c).to_numpy().view(np.uint64) for c in ("gram", "context", "suffix"))
    models = Models(langs, [], [], [], [])
    for k in range(1, order + 1):
        at = level == k
        table, inverse = np.unique(gram[at], return_inverse=True)
        c = np.zeros((len(table), len(langs)))
        c[inverse, which[at]] = count[at]
        if k < order:
            # Continuation counts; an n-gram at the beginning of a word has no character before it.
            above = level == k + 1
            where, hit = _find(table, suffix[above])
            longer = np.zeros_like(c)
            np.add.at(longer, (where[hit], which[above][hit]), 1)
            c = np.where(longer > 0, longer, np.minimum(c, 1))
        first = np.zeros(len(table), np.uint64)
        first[inverse] = context[at]
        contexts, group = np.unique(first, return_inverse=True)
        sums, kinds = np.zeros((len(contexts), len(langs))), np.zeros((len(contexts), len(langs)))
        np.add.at(sums, group, c)
        np.add.at(kinds, group, c > 0)
        weight = np.where(sums > 0, discount * kinds / np.maximum(sums, 1), 1.0)
        if k == 1:
            lower = np.full((len(table), len(langs)), 1.0 / _ALPHABET)
        else:
            below = np.zeros(len(table), np.uint64)
            below[inverse] = suffix[at]
            where, hit = _find(models.grams[k - 2], below)
            lower = np.where(hit[:, None], models.probability[k - 2][where], 1.0 / _ALPHABET) if len(models.grams[k - 2]) else np.full(c.shape, 1.0 / _ALPHABET)
        p = np.maximum(c - discount, 0) / np.maximum(sums[group], 1) + weight[group] * lower
        models.grams.append(table)
        models.probability.append(p)
        models.contexts.append(contexts)
        models.weight.append(weight if len(contexts) else np.ones((1, len(langs))))
    return models


def judge(df: DataFrame, text: str, models: Models, keep: Sequence[str] | None = None) -> DataFrame:
    """Add ``lang_pred``, ``score`` (calibrated, 0 to 1), ``gap`` (nats per character) and ``rejected``."""
    names = np.array([*models.langs, UNKNOWN], object)
    n = len(models.langs)

    def compute(texts):
        for column in texts:
            words, parts = indexed_words(column)
            cost, length = models.log_probability(words) if n and words else (np.zeros((len(words), n)), np.zeros(len(words)))
            letters = np.array([any(map(str.isalpha, w)) for w in words], bool)
            best = np.full(len(column), n, np.int64)
            gap = np.zeros(len(column))
            for i, rows, row, word in parts:
                has = np.bincount(row, letters[word], minlength=rows) > 0 if len(word) else np.zeros(rows, bool)
                chars = np.maximum(np.bincount(row, length[word], minlength=rows), 1)
                if not n or not len(word):
                    continue
                sums = np.stack([np.bincount(row, cost[word, k], minlength=rows) for k in range(n)], axis=1) / chars[:, None]
                choice = np.argmax(sums, axis=1)
                ranked = np.sort(sums, axis=1)
                best[i : i + rows] = np.where(has, choice, n)
                gap[i : i + rows] = np.where(has, ranked[:, -1] - ranked[:, -2] if n > 1 else np.inf, 0)
            score = np.where(best == n, 0.0, 1 / (1 + np.exp(-np.clip(models.intercept + models.slope * np.minimum(gap, 50), -30, 30))) if n > 1 else 1.0)
            yield [pa.array(names[best].tolist(), pa.string()), score, np.minimum(gap, 50), score < REJECT]

    fields = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("gap", DoubleType()), StructField("rejected", BooleanType())]
    return add_columns(df, text, compute, fields, keep)


def fit_curve(gap: np.ndarray, right: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Logistic curve of ``right`` over ``gap`` by Newton steps, with one pseudo-row of each outcome at the ends."""
    x = np.concatenate([gap, [0.0, 0.0, max(gap.max(initial=0.0), 1e-3)]])
    y = np.concatenate([right.astype(float), [0.0, 1.0, 1.0]])
    design = np.stack([np.ones(len(x)), x], axis=1)
    beta = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (y - p) - 1e-3 * beta
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        beta = np.clip(beta + np.linalg.solve(hessian, gradient), -200, 200)
    return float(beta[0]), float(beta[1])


def identify(docs: DataFrame, training: DataFrame, text: str = "text", lang: str = "lang", order: int = ORDER, calibration: int = CALIBRATION, keep: Sequence[str] | None = None) -> DataFrame:
    """Train on ``training`` (rows with a language), calibrate, and judge every row of ``docs``."""
    rows = training.select(training[lang].alias("lang"), training[text].alias("text")).filter("lang is not null")
    models = train(rows, order)
    if len(models.langs) > 1:
        every = max(1, rows.count() // calibration)
        sample = rows.filter(F.pmod(F.xxhash64("text"), F.lit(every)) == 0)
        seen = judge(sample, "text", models, ["lang"]).select("gap", (F.col("lang") == F.col("lang_pred")).alias("right"))
        gap, right = (c.to_numpy() for c in seen.limit(4 * calibration).toArrow().columns)
        models.intercept, models.slope = fit_curve(gap, right)
    return judge(docs, text, models, keep)
