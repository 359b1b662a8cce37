"""Personal data: base patterns, then bootstrapped contextual extraction.

Base kinds (email, ip, card, phone) are fixed patterns; their spans are the
seeds. Every seed and every other identifier-like string (``MIN_DIGITS`` or more
digits) gives occurrences (lexical pattern, instance): the two words before it,
and the word before with the word after. Spark scores the bipartite graph of
distinct patterns and instances in ``ROUNDS`` rounds:

* a seed has score 1, another instance the noisy-or of its patterns' scores;
* a pattern has the mean score of its distinct instances, smoothed by
  ``SMOOTHING`` unsupported ones, and counts only with ``MIN_SUPPORT`` distinct
  instances of positive score. Its nearest word before has a letter.

Patterns of ``CONFIDENCE`` or more report the strings they surround that no base
kind has, as kind ``context``.

Defined results: null and empty texts have no spans; overlapping base kinds are
all kept; context spans overlap none of them; equal rows get equal spans;
positions are code points, the end is exclusive. Columns named like a new one are
replaced, all others stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from pinlattice.llm.batches import add_columns
from pinlattice.llm.spans import SPAN, SPANS
from pinlattice.session import materialize

KINDS = ("email", "ip", "card", "phone")
CONTEXT_KIND = "context"
MIN_DIGITS = 4
MIN_SUPPORT = 5
SMOOTHING = 1.0
CONFIDENCE = 0.6
ROUNDS = 3

# FIXED VALUES: the base patterns. A run of digits that fails is not tried again from its
# middle (it would fail there too), and an address is looked for around each "@".
_DOMAIN = re.compile("@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile("(?<![0-9])[0-9]++(?:\\.[0-9]++){3}")
_CARD = re.compile("[0-9](?:[\\x20-]?[0-9])+")
_PHONE = re.compile("\\+[0-9][\\x20().0-9-]+[0-9]")

_CANDIDATE = re.compile("[A-Za-z0-9][A-Za-z0-9._/-]*+")
_DIGIT = re.compile("[0-9]")
_WORD_BEFORE = 40

Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at)
        start = at
        if domain:
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
        if start < at:
            end = domain.end()
            yield start, end
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_spans(text: str) -> list[Span]:
    """Base spans by kind, then start."""
    found: list[Span] = [("email", a, b) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return found
    found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_DIGIT.findall(m.group())) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


def _key(text: str) -> int:
    raw = text.encode()
    value = crc32(raw) << 32 | crc32(raw, 0x5EED)
    return value - (1 << 64) if value >> 63 else value


def _shape(word: str) -> str:
    return _DIGIT.sub("0", word.lower())


def patterns_of(text: str, start: int, end: int) -> list[int]:
    """The lexical patterns around a string: two words before; word before and word after."""
    before = text[max(0, start - _WORD_BEFORE * 2) : start].split()[-2:]
    after = text[end : end + _WORD_BEFORE].split()[:1]
    out = []
    if not before or not any(map(str.isalpha, before[-1])):
        return out  # a pattern is lexical: the nearest word has a letter
    if len(before) == 2:
        out.append(_key("L\x00" + "\x00".join(map(_shape, before))))
    if after:
        out.append(_key("M\x00" + _shape(before[-1]) + "\x00" + _shape(after[0])))
    return out


def candidates(text: str, taken: list[Span]) -> list[tuple[int, int]]:
    """Identifier-like strings outside the base spans."""
    if not _DIGIT.search(text):
        return []
    out, spans, k = [], sorted((a, b) for _, a, b in taken), 0
    for m in _CANDIDATE.finditer(text):
        start, end = m.span()
        while end > start and text[end - 1] in "._/-":
            end -= 1
        if len(_DIGIT.findall(text, start, end)) < MIN_DIGITS:
            continue
        while k < len(spans) and spans[k][1] <= start:
            k += 1
        if not any(a < end and start < b for a, b in spans[k : k + len(KINDS) + 1]):
            out.append((start, end))
    return out


def pattern_graph(docs: DataFrame, text: str) -> DataFrame:
    """Distinct edges (pattern, instance) with ``seed``: whether the instance is a base span somewhere."""

    def run(batches):
        for batch in batches:
            edges = set()
            for value in batch.column(0):
                body = value.as_py() or ""
                spans = base_spans(body)
                found = [(a, b, True) for _, a, b in spans] + [(a, b, False) for a, b in candidates(body, spans)]
                for a, b, seed in found:
                    instance = _key(body[a:b].lower())
                    edges.update((p, instance, seed) for p in patterns_of(body, a, b))
            columns = list(zip(*edges, strict=True)) if edges else [(), (), ()]
            kinds = (pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["pattern", "instance", "seed"])

    edges = docs.select(docs[text].alias("text")).mapInArrow(run, "pattern long, instance long, seed boolean")
    return edges.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))


def score_patterns(
    graph: DataFrame, rounds: int = ROUNDS, smoothing: float = SMOOTHING, support: int = MIN_SUPPORT
) -> DataFrame:
    """(pattern, score) after ``rounds`` of mutual scoring; each round is written once."""
    edges = materialize(graph)
    seeds = edges.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("score"))
    instances = materialize(seeds)
    patterns = None
    for _ in range(rounds):
        patterns = (
            edges.join(instances, "instance")
            .groupBy("pattern")
            .agg((F.sum("score") / (F.count(F.lit(1)) + smoothing)).alias("score"), F.sum((F.col("score") > 0).cast("long")).alias("support"))
            .filter((F.col("support") >= support) & (F.col("score") > 0))
            .select("pattern", "score")
        )
        patterns = materialize(patterns)
        # 1 - product of (1 - score); the clamp keeps the logarithm finite.
        doubt = F.exp(F.sum(F.log(1 - F.least("score", F.lit(0.999999)))))
        reached = edges.join(patterns, "pattern").groupBy("instance").agg((1 - doubt).alias("new"))
        instances = materialize(
            seeds.join(reached, "instance", "left").select(
                "instance", F.when(F.col("score") > 0, F.col("score")).otherwise(F.coalesce("new", F.lit(0.0))).alias("score")
            )
        )
    return patterns


_CANDIDATES = ArrayType(
    StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("patterns", ArrayType(LongType()))])
)


def _base_and_candidates(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    candidate_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("patterns", pa.list_(pa.int64()))]))

    def compute(texts):
        for column in texts:
            spans, others = [], []
            for value in column:
                body = value.as_py() or ""
                found = base_spans(body)
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
                others.append([{"start": a, "end": b, "patterns": patterns_of(body, a, b)} for a, b in candidates(body, found)])
            yield [pa.array(spans, span_type), pa.array(others, candidate_type)]

    return add_columns(docs, text, compute, [StructField("__base", SPANS), StructField("__others", _CANDIDATES)], keep)


def find_personal(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", confidence: float = CONFIDENCE) -> DataFrame:
    """All rows and columns of ``docs`` plus ``personal_spans``: base spans by kind and start, then context spans."""
    patterns = score_patterns(pattern_graph(docs, text)).filter(F.col("score") >= confidence).select(F.col("pattern").alias("__pattern"))
    kept = [c for c in docs.columns if c != "personal_spans"]
    narrow = docs.select(docs[doc_id].alias("id"), F.xxhash64(docs[text]).alias("key"), docs[text].alias("body"))
    # Only candidates of texts that have some are matched; the patterns join sees no other row.
    found = _base_and_candidates(narrow, "body", ["id", "key"]).select(
        "id", "key", F.explode("__others").alias("o")
    ).select("id", "key", F.col("o.start").alias("start"), F.col("o.end").alias("end"), F.explode("o.patterns").alias("pattern"))
    context = (
        found.join(patterns, found["pattern"] == patterns["__pattern"], "left_semi")
        .groupBy("id", "key")
        .agg(F.array_sort(F.collect_set(F.struct(F.lit(CONTEXT_KIND).alias("kind"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")))).alias("more"))
    )
    with_base = _base_and_candidates(docs.select(*[docs[c] for c in kept], F.xxhash64(docs[text]).alias("__key")), text, [*kept, "__key"])
    joined = with_base.join(context, with_base[doc_id].eqNullSafe(context["id"]) & (with_base["__key"] == context["key"]), "left")
    empty = F.array().cast(ArrayType(SPAN))
    return joined.select(*[with_base[c] for c in kept], F.concat(with_base["__base"], F.coalesce(context["more"], empty)).alias("personal_spans"))
