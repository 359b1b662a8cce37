"""Phrase collocation mining by SON partitioning.

A phrase that occurs ``MIN_COUNT`` times in all occurs at least ``MIN_COUNT / SHARDS`` times
(rounded up) in one of ``SHARDS`` shards. First pass: each shard is mined completely at that
support. A task's texts belong to one shard; it lists the distinct phrases of a few megabytes
of text as sorted hashes with counts, cut into parts of the range of hashes, and the lists of
one (shard, part) meet in one group. The locally frequent hashes of all shards are united in a
bit filter. Second pass: every phrase that passes the filter is counted over all texts by its
words, so hashes decide nothing but what may be left out: equal hashes of different phrases
only add candidates.

The number of shards is fixed, so the local support stays where it prunes at any corpus size;
larger corpora get more parts. The filter has at most ``FILTER_BITS`` bits; a corpus with more
candidates than it can tell apart lets more phrases through to the exact count, and the result
stays the same.

Defined results: a null text counts as empty, a null language as ``und``. Repeated rows are
counted each. Without texts there are no rows. Other columns are not read. Phrases and languages
are ordered by their UTF-8 bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pinlattice.llm.batches import Piece, Words, byte_class, group_runs, mix, pieces
from pinlattice.llm.stored import look_up, stored

MIN_COUNT = 30
MAX_WORDS = 4
COVERED = 80  # per cent of its occurrences inside one longer phrase that make a phrase redundant
TOP = 2000
SCORE_SCALE = 2_000_000
SHARDS = 14
BLOCK_BYTES = 2 << 20
PART_BYTES = 32 << 20
FILTER_BITS = 1 << 29
_SEGMENT_BITS = 1 << 22
_PROBES = 3
_REST_BITS = 32

_BREAK = byte_class(lambda b: chr(b) in ".,;:!?" or 0x0A <= b <= 0x0D)
_INSIDE = byte_class(lambda b: not (chr(b) in " \t.,;:!?" or 0x0A <= b <= 0x0D))


class Phrases:
    """The phrases of 1 to ``longest`` words of some texts, each text with the hash of its language."""

    def __init__(self, piece: Piece, langs: np.ndarray, longest: int):
        self.words = Words(piece, _INSIDE, True)
        breaks = np.cumsum(_BREAK[piece.data])
        at = self.words.starts
        # Words of one run follow each other in one piece of one text.
        run = (breaks[at] if len(at) else np.zeros(0, np.int64)) + self.words.text
        self.hashes, self.first, self.length = [], [], []
        salt = langs[self.words.text]
        h = self.words.hashes
        rolled = np.zeros(len(h), np.uint64)
        for n in range(1, longest + 1):
            m = max(len(h) - n + 1, 0)
            rolled = mix(rolled[:m] + h[n - 1 :] * np.uint64(2 * n + 1))
            whole = np.flatnonzero(run[:m] == run[n - 1 :])
            self.hashes.append(mix(rolled[whole] ^ salt[whole]))
            self.first.append(whole)
            self.length.append(n)

    def texts(self, n: int, first: np.ndarray) -> list[bytes]:
        """The phrases of n words from the given first words on, joined by single spaces."""
        raw, starts, ends = self.words.data.tobytes(), self.words.starts, self.words.ends
        if n == 1:
            return [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        a, b = starts[first], ends[first + n - 1]
        # With single spaces between its words a phrase is one slice of the text.
        plain = (ends[first + n - 1] - a) == sum(ends[first + k] - starts[first + k] for k in range(n)) + n - 1
        out = []
        for i, (x, y, ok) in enumerate(zip(a.tolist(), b.tolist(), plain.tolist(), strict=True)):
            out.append(raw[x:y].replace(b"\t", b" ") if ok else b" ".join(raw[starts[first[i] + k] : ends[first[i] + k]] for k in range(n)))
        return out


def _lang_hashes(langs: pa.Array) -> tuple[np.ndarray, list[str]]:
    """A hash per row, and the language of each row."""
    names = langs.to_pylist()
    known = {x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in set(names)}
    return np.array([known[x] for x in names], np.uint64), names


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Piece]]:
    """Rows (lang, text) of a few megabytes of text at once, or one longer text."""
    for batch in batches:
        for i, j, piece in pieces(batch.column(1), BLOCK_BYTES):
            yield batch.slice(i, j - i), piece


def _write(values: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted numbers of 32 bits as differences, byte plane by byte plane, then counts above one."""
    steps = np.diff(values, prepend=np.uint32(0)).astype("<u4")
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes()
    many = np.flatnonzero(counts > 1).astype("<u4")
    head = np.array([len(values), len(many)], "<u4").tobytes()
    return zstandard.compress(head + planes + many.tobytes() + counts[many].astype("<u4").tobytes(), 1)


def _read(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.decompress(payload)
    n, m = np.frombuffer(raw, "<u4", 2).tolist()
    planes = np.frombuffer(raw, np.uint8, 4 * n, 8).reshape(4, n)
    values = np.cumsum(np.ascontiguousarray(planes.T).view("<u4").reshape(-1), dtype=np.uint32)
    counts = np.ones(n, np.int64)
    counts[np.frombuffer(raw, "<u4", m, 8 + 4 * n)] = np.frombuffer(raw, "<u4", m, 8 + 4 * (n + m))
    return values, counts


def _merge(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    values = np.concatenate([v for v, _ in lists])
    counts = np.concatenate([c for _, c in lists])
    order = np.argsort(values)
    values, counts = values[order], counts[order]
    starts = group_runs(values)
    return values[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def _probes(key: np.ndarray, bits: int) -> np.ndarray:
    """The filter positions of keys, one row per probe."""
    return np.stack([mix(key + np.uint64(k * 0x632BE59BD9B4E019 & (1 << 64) - 1)) & np.uint64(bits - 1) for k in range(1, _PROBES + 1)])


def local_candidates(source: DataFrame, part_bits: int, support: int, longest: int) -> DataFrame:
    """Pass one: rows (part, n, payload), the hashes that are frequent in one shard at least."""
    shift = np.uint64(64 - part_bits - _REST_BITS)

    def mine(batches):
        shard = TaskContext.get().partitionId() % SHARDS
        for batch, piece in _blocks(batches):
            langs, _ = _lang_hashes(batch.column(0))
            found = Phrases(piece, langs, longest)
            keys, counts = np.unique(np.concatenate(found.hashes) >> shift, return_counts=True)
            if not len(keys):
                continue
            part = (keys >> np.uint64(_REST_BITS)).astype(np.int64)
            starts = group_runs(part)
            ends = np.append(starts[1:], len(keys))
            rest = (keys & np.uint64((1 << _REST_BITS) - 1)).astype(np.uint32)
            payload = [_write(rest[a:b], counts[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(starts), shard, np.int32)), pa.array(part[starts].astype(np.int32)), pa.array(payload, pa.binary())],
                names=["shard", "part", "payload"],
            )

    def frequent(table: pa.Table) -> pa.Table:
        values, counts = _merge([_read(x.as_buffer()) for x in table.column("payload")])
        values = values[counts >= support]
        if not len(values):
            return pa.table([pa.array([], pa.int32()), pa.array([], pa.int64()), pa.array([], pa.binary())], names=["part", "n", "payload"])
        payload = _write(values, np.ones(len(values), np.int64))
        return pa.table([table.column("part").slice(0, 1), pa.array([len(values)]), pa.array([payload], pa.binary())], names=["part", "n", "payload"])

    listed = source.mapInArrow(mine, "shard int, part int, payload binary")
    return listed.groupBy("shard", "part").applyInArrow(frequent, "part int, n long, payload binary")


def candidate_filter(candidates: DataFrame) -> tuple[bytes, int]:
    """The united candidates of all shards as a bit filter: sixteen bits each, ``FILTER_BITS`` at most."""
    total = candidates.agg(F.sum("n").alias("n")).first()["n"] or 0
    bits = min(FILTER_BITS, max(_SEGMENT_BITS, 1 << (16 * total).bit_length()))

    def positions(batches):
        for batch in batches:
            for part, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values, _ = _read(payload.as_buffer())
                at = np.unique(_probes((np.uint64(part) << np.uint64(_REST_BITS)) | values.astype(np.uint64), bits))
                segment = (at // np.uint64(_SEGMENT_BITS)).astype(np.int64)
                starts = group_runs(segment)
                inner = (at % np.uint64(_SEGMENT_BITS)).astype(np.uint32)
                packed = [_write(x, np.ones(len(x), np.int64)) for x in np.split(inner, starts[1:])] if len(at) else []
                yield pa.RecordBatch.from_arrays([pa.array(segment[starts].astype(np.int32)), pa.array(packed, pa.binary())], names=["segment", "payload"])

    def unite(table: pa.Table) -> pa.Table:
        flags = np.zeros(_SEGMENT_BITS, bool)
        for payload in table.column("payload"):
            flags[_read(payload.as_buffer())[0]] = True
        packed = zstandard.compress(np.packbits(flags).tobytes(), 1)
        return pa.table([table.column("segment").slice(0, 1), pa.array([packed], pa.binary())], names=["segment", "payload"])

    rows = candidates.select("part", "payload").mapInArrow(positions, "segment int, payload binary")
    flags = np.zeros(bits // 8, np.uint8)
    width = _SEGMENT_BITS // 8
    # One row of half a megabyte per segment, FILTER_BITS / 8 bytes in all.
    for segment, payload in rows.groupBy("segment").applyInArrow(unite, "segment int, payload binary").collect():
        flags[segment * width : (segment + 1) * width] = np.frombuffer(zstandard.decompress(bytes(payload)), np.uint8)
    return flags.tobytes(), bits


def exact_counts(source: DataFrame, passes: tuple[bytes, int], part_bits: int, least: int, longest: int) -> DataFrame:
    """Pass two: rows (lang, phrase, words, a), every phrase that occurs ``least`` times, counted over all texts."""
    shift = np.uint64(64 - part_bits - _REST_BITS)
    bits = passes[1]
    shared = source.sparkSession.sparkContext.broadcast(passes[0])

    def count(batches):
        flags = np.frombuffer(shared.value, np.uint8)
        for batch, piece in _blocks(batches):
            langs, names = _lang_hashes(batch.column(0))
            found = Phrases(piece, langs, longest)
            text = found.words.text
            for hashes, first, n in zip(found.hashes, found.first, found.length, strict=True):
                keys, at, counts = np.unique(hashes, return_index=True, return_counts=True)
                may = np.ones(len(keys), bool)
                for p in _probes(keys >> shift, bits):
                    # packbits puts the first flag into the highest bit.
                    may &= (flags[p >> np.uint64(3)] >> (np.uint64(7) - (p & np.uint64(7))).astype(np.uint8)) & 1 == 1
                at, counts = first[at[may]], counts[may]
                lang = pa.array(names, pa.string()).take(pa.array(text[at]))
                yield pa.RecordBatch.from_arrays(
                    [lang, pa.array(found.texts(n, at), pa.binary()).cast(pa.string()), pa.array(np.full(len(at), n, np.int32)), pa.array(counts.astype(np.int64))],
                    names=["lang", "phrase", "words", "a"],
                )

    listed = source.mapInArrow(count, "lang string, phrase string, words int, a long")
    return listed.groupBy("lang", "phrase", "words").agg(F.sum("a").alias("a")).filter(F.col("a") >= least)


def frequent_phrases(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = MIN_COUNT, longest: int = MAX_WORDS, min_part_bits: int = 5
) -> DataFrame:
    """Rows (lang, phrase, words, a): every phrase of up to ``longest`` words with ``least`` occurrences, stored."""
    source = docs.select(F.coalesce(docs[lang].cast("string"), F.lit("und")).alias("lang"), docs[text].alias("text"))
    size = source.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    part_bits = max(min_part_bits, (size // PART_BYTES).bit_length())
    local = -(-least // SHARDS)
    candidates = stored(local_candidates(source, part_bits, local, longest), "phrase-candidates")
    return stored(exact_counts(source, candidate_filter(candidates), part_bits, least, longest), "phrase-counts")


def word_totals(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Rows (lang, n): all word occurrences."""
    source = docs.select(F.coalesce(docs[lang].cast("string"), F.lit("und")).alias("lang"), docs[text].alias("text"))

    def count(batches):
        for batch in batches:
            for i, j, piece in pieces(batch.column(1), BLOCK_BYTES):
                flags = _INSIDE[piece.data]
                opens = flags.copy()
                opens[1:] &= ~flags[:-1]
                edges = piece.offsets[:-1]
                edges = edges[edges < len(flags)]
                opens[edges] = flags[edges]
                n = pa.array(piece.per_text(opens).astype(np.int64))
                sums = pa.table([batch.column(0).slice(i, j - i), n], names=["lang", "n"]).group_by("lang").aggregate([("n", "sum")])
                yield from pa.table([sums.column("lang"), pc.cast(sums.column("n_sum"), pa.int64())], names=["lang", "n"]).to_batches()

    return source.mapInArrow(count, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n"))


def _wide(c: Column | int) -> Column:
    """A number as a decimal of 38 digits, in which products of counts stay exact."""
    return (c if isinstance(c, Column) else F.lit(c)).cast("decimal(38,0)")


def _slice(first: int | Column, n: int | Column) -> Column:
    return F.array_join(F.slice("parts", first, n), " ")


def cut_scores(counts: DataFrame) -> DataFrame:
    """Phrases of two words or more with l, r and the score of their lowest-scoring cut."""
    phrases = counts.filter(F.col("words") > 1).select("*", F.split("phrase", " ").alias("parts"))
    cuts = phrases.select("lang", "phrase", "words", "a", "parts", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = stored(
        cuts.select("lang", "phrase", "words", "a", "k", _slice(1, F.col("k")).alias("head"), _slice(F.col("k") + 1, F.col("words") - F.col("k")).alias("tail")),
        "phrase-cuts",
    )
    known = counts.select("lang", "phrase", "a")
    with_l = stored(look_up(cuts, known.toDF("lang", "head", "l"), ["lang", "head"]), "phrase-heads")
    both = look_up(with_l, known.toDF("lang", "tail", "r"), ["lang", "tail"])
    scored = both.withColumn("score", F.expr(f"cast(({SCORE_SCALE} * cast(a as decimal(30,0))) div cast(l + r as decimal(38,0)) as bigint)"))
    best = F.min_by(F.struct("l", "r", "score"), F.struct("score", "k"))
    return scored.groupBy("lang", "phrase", "words", "a").agg(best.alias("best")).select("lang", "phrase", "words", "a", "best.*")


def redundant(counts: DataFrame, covered: int = COVERED) -> DataFrame:
    """Rows (lang, phrase): phrases that a longer one with ``covered`` per cent of their occurrences holds."""
    longer = counts.filter(F.col("words") > 2).select("lang", "words", F.col("a").alias("longer"), F.split("phrase", " ").alias("parts"))
    spans = longer.select("*", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("n"))
    spans = spans.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("n") + 1)).alias("at"))
    most = spans.select("lang", _slice(F.col("at"), F.col("n")).alias("phrase"), "longer").groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    held = counts.filter(F.col("words") > 1).join(most, ["lang", "phrase"])
    return held.filter(100 * _wide(F.col("longer")) >= covered * _wide(F.col("a"))).select("lang", "phrase")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = MIN_COUNT, longest: int = MAX_WORDS, top: int = TOP) -> DataFrame:
    """Each language's ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    counts = frequent_phrases(docs, text, lang, least, longest)
    kept = cut_scores(counts).join(redundant(counts), ["lang", "phrase"], "left_anti")
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    out = ranked.join(word_totals(docs, text, lang), "lang")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
