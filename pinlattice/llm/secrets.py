"""Secret scan: base patterns, then dictionary-primed zstandard novelty.

Base kinds are fixed patterns (``assign``, ``access``, ``hex``). The method looks
at every other unbroken string of ``MIN_LENGTH`` or more characters with a digit
and a letter whose surroundings (``CONTEXT`` characters before it) name something
sensitive. A string with an inner equals sign is a name and a value: the name counts as
surroundings of the value. Its novelty is the number of bytes zstandard needs for it after a
dictionary of the corpus' most frequent identifiers and its own surroundings,
divided by its length: an identifier or a repeat of nearby text costs next to
nothing, random key material costs nearly its entropy. Strings of at least
``NOVELTY`` bytes per character are reported as kind ``novel``.

The dictionary is counted over all texts (identifiers of four or more
characters, by frequency) and cut to ``DICTIONARY_WORDS`` entries, so it travels with the tasks.

Defined results: null and empty texts have no spans; overlaps of a novel string
with a base span are not reported twice (the base span stays, the rest of the
string is tested and reported beside it); positions are code
points, the end is exclusive. Columns named like a new one are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

from pinlattice.llm.batches import add_columns
from pinlattice.llm.spans import SPANS

KINDS = ("assign", "access", "hex")
NOVEL = "novel"
MIN_LENGTH = 16
CONTEXT = 48
NOVELTY = 0.6
DICTIONARY_WORDS = 4096

# FIXED VALUES: the base patterns.
_KEYWORD = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
_ASSIGN = re.compile(_KEYWORD + "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile("AKIA[A-Z0-9]+")
# Runs of 16 or more are whole runs: a shorter run before cannot overlap them.
_HEX = re.compile("[0-9a-f]{16,}")
_WORDS_OF_ASSIGN = ("password", "passwd", "secret", "token", "apikey", "api_key")

_SENSITIVE = re.compile("pass|pwd|secret|token|key|auth|cred|bearer|private|signature|session|cookie|login|akia", re.ASCII | re.IGNORECASE)
# Possessive: a failing string is not tried again from its middle.
_CANDIDATE = re.compile("(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{%d,}+" % MIN_LENGTH)
# Name and value around the first inner equals sign; signs at the end are padding.
_ASSIGNED = re.compile("([^=]+)=+([^=].*)", re.DOTALL)
_IDENTIFIER = re.compile("[A-Za-z_][A-Za-z0-9_]{3,}")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    found: list[Span] = []
    lowered = text.lower()
    if any(word in lowered for word in _WORDS_OF_ASSIGN):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return found


class Novelty:
    """Marginal compressed size behind a dictionary and a context."""

    def __init__(self, dictionary: bytes):
        options = {"level": 3, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        if len(dictionary) >= 8:
            primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            primed.precompute_compress(level=3)
            options["dict_data"] = primed
        self.compressor = zstandard.ZstdCompressor(**options)

    def __call__(self, context: str, candidate: str) -> float:
        before = context.encode()
        whole = self.compressor.compress(before + candidate.encode())
        return (len(whole) - len(self.compressor.compress(before))) / len(candidate)


def _uncovered(start: int, end: int, taken: Sequence[Span]) -> list[tuple[int, int]]:
    """The parts of a range outside all spans."""
    parts = []
    for _, a, b in sorted((s for s in taken if s[1] < end and start < s[2]), key=lambda s: s[1:]):
        if start < a:
            parts.append((start, a))
        start = max(start, b)
    return [*parts, (start, end)] if start < end else parts


def novel_spans(text: str, taken: Sequence[Span], novelty: Novelty, threshold: float = NOVELTY, rest: bool = False) -> list[Span]:
    """Novel spans; with ``rest`` also what is left of a string that overlaps a ``taken`` span."""
    found: list[Span] = []

    def test(start: int, end: int, first: int) -> bool:
        """Report what of a range no base span covers; its context begins before ``first``."""
        parts = _uncovered(start, end, taken)
        if not rest and parts != [(start, end)]:
            return False
        value = "".join(text[a:b] for a, b in parts)
        if len(value) < MIN_LENGTH or not re.search("[0-9]", value) or not re.search("[A-Za-z]", value):
            return False
        context = text[max(0, first - CONTEXT) : start]
        if not _SENSITIVE.search(context):
            return False
        after = text[end : end + CONTEXT]
        if novelty(context + after + " ", value) < threshold:
            return False
        found.extend((NOVEL, a, b) for a, b in parts)
        return True

    for m in _CANDIDATE.finditer(text):
        start, end = m.span()
        split = _ASSIGNED.fullmatch(m.group())
        if split:
            # An unspaced assignment: its name is context of its value. Either may be the secret.
            of_value = test(start + split.start(2), end, start)
            of_name = test(start, start + split.end(1), start)
            if of_value or of_name:
                continue
        test(start, end, start)
    return found


def identifier_dictionary(docs: DataFrame, text: str, words: int = DICTIONARY_WORDS) -> bytes:
    """The most frequent identifiers of all texts, the commonest last (nearest to the data)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[str] = Counter()
            for value in batch.column(0):
                seen.update(_IDENTIFIER.findall(value.as_py() or ""))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    top = (
        docs.select(docs[text].alias("text"))
        .mapInArrow(count, "word string, n long")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "word")
        .limit(words)
        .collect()
    )
    return " ".join(r["word"] for r in reversed(top)).encode()


def find_secrets(docs: DataFrame, text: str = "text", dictionary: bytes | None = None, threshold: float = NOVELTY, keep: Sequence[str] | None = None) -> DataFrame:
    """Add ``secret_spans``: base and novel spans by start, then kind."""
    if dictionary is None:
        dictionary = identifier_dictionary(docs, text)
    order = {kind: i for i, kind in enumerate((*KINDS, NOVEL))}

    def compute(texts):
        novelty = Novelty(dictionary)
        for column in texts:
            rows = []
            for value in column:
                body = value.as_py() or ""
                spans = base_spans(body)
                spans += novel_spans(body, spans, novelty, threshold, rest=True)
                spans.sort(key=lambda s: (s[1], order[s[0]]))
                rows.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
            yield [pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))]

    return add_columns(docs, text, compute, [StructField("secret_spans", SPANS)], keep)


def redact(docs: DataFrame, text: str = "text", spans: str = "secret_spans", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of the text replaced by ``mark``; overlapping spans are replaced once."""
    body, found = F.col(text), F.col(spans)
    step = F.aggregate(
        found,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(body, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)))
            .otherwise(acc["out"])
            .alias("out"),
            F.greatest(acc["at"], s["end"]).alias("at"),
        ),
    )
    replaced = F.concat(step["out"], F.substring(body, step["at"] + 1, F.length(body)))
    return docs.withColumn(text, F.when(F.size(found) > 0, replaced).otherwise(body))
