"""Language-model scoring by prediction by partial matching.

A text is a sequence of tokens: lower-cased words, then one end. The model codes
the bytes of each word, a terminator after it and the end with the preceding bytes
as context (up to ``ORDER``). With ``across`` the context runs over token edges, back to the
beginning of the text; else it begins anew with every token.

Training counts how often each byte follows each run of ``CONTEXT`` bytes. Byte
contexts form a trie, kept as sorted arrays of exact integer keys (order, context,
symbol). Escape method D: a context with total T and D distinct symbols gives a
symbol seen c times (2c - 1) / 2T and the escape D / 2T. Symbols already excluded
in the longer context are taken out of T and D (symbol exclusion). Below order 0 all
remaining byte values are equally likely, so every text has a finite code length.

No pair of context and symbol is left out. The pairs are a table of parts, by the
last ``SHARED`` + 1 bytes of the context, so a part holds every longer context of its
keys. What is asked of it are the distinct keys of blocks of texts, which meet the
part's pairs once each and go back to their blocks with their values. Where the
training rows are rows of the blocks, the keys bring their training counts along.
Only the
pairs of orders up to ``SHARED`` belong to all parts and travel with the tasks; the
alphabet bounds them, not the corpus.

Defined results: null and empty texts are one end token; without training rows
all counts are zero and bytes are uniform; null ids count as an empty id for the
fold (held out). Columns named like a new one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField

from pinlattice.llm.batches import NOT_SPACE, Piece, Words, group_runs, mix, pieces, sliced, span_hashes, text_bytes
from pinlattice.llm.distinct_words import join_words, unpack
from pinlattice.session import materialize

ORDER = 6
# Bytes of context in a key; before a token (or text) stand ends and one edge.
CONTEXT = 6
# Orders up to this are known to every part.
SHARED = 2
# A part of the pairs is for so many bytes of training texts; texts travel in blocks of so many.
PART_BYTES = 4 << 20
BLOCK_BYTES = 8 << 20
_EDGE, _END = 0x20, 0x0A
_ALPHABET = 256
_NONE, _NO_COUNTS = np.zeros(0, np.uint64), np.zeros(0, np.int64)


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def _count_words(piece: Piece, words: Words, counts: dict[bytes, int]) -> None:
    _, first, n = np.unique(words.hashes, return_index=True, return_counts=True)
    for word, times in zip(words.bytes_of(first), n.tolist(), strict=True):
        counts[word] = counts.get(word, 0) + times


def distinct_words(texts: pa.Array | pa.ChunkedArray) -> tuple[list[str], np.ndarray]:
    """Distinct lower-cased words of some texts and how often each occurs."""
    counts: dict[bytes, int] = {}
    for _, _, piece in pieces(texts):
        _count_words(piece, Words(piece, NOT_SPACE, True), counts)
    return [w.decode() for w in counts], np.fromiter(counts.values(), np.int64, len(counts))


def training_counts(training: DataFrame, text: str, order: int, across: bool) -> DataFrame:
    """(word, pair, n): every word of the training texts (``pair`` null) and every pair of the order up to ``SHARED``
    (``word`` null) with its count, summed inside the tasks first."""
    low = min(order, SHARED)

    def run(batches):
        for batch in batches:
            words: dict[bytes, int] = {}
            pairs, times = [_NONE], [_NO_COUNTS]
            for _, _, piece in pieces(batch.column(0)):
                found = Words(piece, NOT_SPACE, True)
                _count_words(piece, found, words)
                keys = coded_keys(piece, found, across)[0].astype(np.uint32) & np.uint32((1 << (8 * (low + 1))) - 1)
                keys, n = np.unique(keys, return_counts=True)
                pairs.append(keys.astype(np.uint64) | np.uint64((low + 1) << 56))
                times.append(n)
            pair, n = _sum_equal(np.concatenate(pairs), np.concatenate(times))
            columns = [pa.array([w.decode() for w in words] + [None] * len(pair), pa.string())]
            columns.append(pa.concat_arrays([pa.nulls(len(words), pa.int64()), pa.array(pair.view(np.int64))]))
            columns.append(pa.array(np.concatenate([np.fromiter(words.values(), np.int64, len(words)), n])))
            yield pa.RecordBatch.from_arrays(columns, names=["word", "pair", "n"])

    counted = training.select(training[text].alias("text")).mapInArrow(run, "word string, pair long, n long")
    return counted.groupBy("word", "pair").agg(F.sum("n").alias("n"))


def _contexts(words: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, context, word) of every coded byte; ``context`` holds the last ``order`` bytes, 8 bits each, and
    the place of the symbol in its token tells how many of them are real."""
    data, offsets = text_bytes(words)
    n = len(offsets) - 1
    length = np.diff(offsets) + 2
    begin = np.concatenate(([0], np.cumsum(length)))
    tokens = np.full(begin[-1], _EDGE, np.uint8)
    owner = np.repeat(np.arange(n), length)
    place = np.arange(begin[-1]) - begin[owner]
    inside = (place > 0) & (place < length[owner] - 1)
    tokens[inside] = data
    coded = np.flatnonzero(place > 0)
    context = np.zeros(len(coded), np.uint64)
    for k in range(order, 0, -1):
        before = tokens[np.maximum(coded - k, 0)].astype(np.uint64)
        context = (context << np.uint64(8)) | np.where(place[coded] >= k, before, np.uint64(0))
    return tokens[coded], context, np.stack([owner[coded], place[coded]])


def _context_keys(context: np.ndarray, k: int) -> np.ndarray:
    """Exact key of the last k bytes: the order, then the bytes."""
    mask = np.uint64((1 << (8 * k)) - 1)
    return (np.uint64(k + 1) << np.uint64(48)) | (context & mask)


def coded_keys(piece: Piece, words: Words, across: bool) -> tuple[np.ndarray, np.ndarray]:
    """(key, text) of every coded byte, text by text; key = the ``CONTEXT`` bytes before it, then the byte."""
    length = words.ends - words.starts
    lead_word, lead_end = np.full(len(length), CONTEXT), np.full(piece.n, CONTEXT)
    if across:  # only the first token of a text has nothing before it
        lead_word[np.flatnonzero(words.text[1:] == words.text[:-1]) + 1] = 0
        lead_end[words.counts > 0] = 0
    word_sums = np.concatenate(([0], np.cumsum(lead_word + length + 1)))
    end_sums = np.concatenate(([0], np.cumsum(lead_end + 1)))
    begin = word_sums[:-1] + end_sums[words.text] + lead_word
    end = word_sums[words.bounds[1:]] + end_sums[:-1] + lead_end
    stream = np.full(word_sums[-1] + end_sums[-1], _END, np.uint8)
    coded = np.zeros(len(stream), bool)
    at = np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(length.sum())
    stream[at] = words.data[words.flags]
    stream[begin[lead_word > 0] - 1] = stream[end[lead_end > 0] - 1] = stream[begin + length] = _EDGE
    coded[at] = coded[begin + length] = coded[end] = True
    keys = stream.astype(np.uint64)
    for k in range(1, CONTEXT + 1):
        keys[k:] |= stream[:-k].astype(np.uint64) << np.uint64(8 * k)
    per_text = np.bincount(words.text, length + 1, minlength=piece.n).astype(np.int64) + 1
    return keys[coded], np.repeat(np.arange(piece.n), per_text)


def _text_keys(texts: pa.Array | pa.ChunkedArray, across: bool) -> Iterator[np.ndarray]:
    """The keys of runs of texts."""
    for _, _, piece in pieces(texts):
        yield coded_keys(piece, Words(piece, NOT_SPACE, True), across)[0]


def _distinct(keys: np.ndarray) -> np.ndarray:
    """The distinct keys, sorted; a plain sort is much faster than the hash table of ``np.unique``."""
    keys = np.sort(keys)
    return keys[group_runs(keys)]


class _Index:
    """Places of distinct keys in ``order``, that of the scrambled keys: these are spread evenly, so their first bits nearly give the place."""

    def __init__(self, keys: np.ndarray):
        scrambled = mix(keys)
        self.order = np.argsort(scrambled)
        self.scrambled = scrambled[self.order]
        bits = max(1, len(keys).bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.scrambled, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def places(self, keys: np.ndarray, what: str) -> np.ndarray:
        asked = mix(keys)
        if not len(self.order) and len(asked):
            raise RuntimeError(f"{what} of a block was not looked up")
        at = self.first[(asked >> self.shift).astype(np.int64)]
        last = len(self.order) - 1
        behind = np.flatnonzero(self.scrambled[np.minimum(at, last)] != asked)
        while len(behind):
            at[behind] += 1
            if (at[behind] > last).any() or (self.scrambled[at[behind]] > asked[behind]).any():
                raise RuntimeError(f"{what} of a block was not looked up")
            behind = behind[self.scrambled[at[behind]] != asked[behind]]
        return at


def _sum_equal(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and the sum of ``n`` of each."""
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = group_runs(keys)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _pack_numbers(x: np.ndarray) -> bytes:
    """Sorted keys or other 8-byte values, compressed; bytes of one place stand together."""
    if x.dtype == np.uint64:
        x = np.diff(x, prepend=np.uint64(0))
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpack_numbers(payload: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(payload), np.uint8).reshape(8, -1)
    x = np.ascontiguousarray(raw.T).reshape(-1).view(kind)
    return np.cumsum(x, dtype=np.uint64) if kind is np.uint64 else x


def _pack_values(count: np.ndarray, total: np.ndarray, value: np.ndarray) -> bytes:
    """Log10 probabilities: as two small numbers where the longest context has the symbol (``count`` of ``total``), which
    compress well; else (``count`` 0) the value itself, whose bits hardly do."""
    packed = [_pack_numbers(x) for x in (count, total, value[count == 0])]
    return b"".join([np.array([len(x) for x in packed], np.int64).tobytes(), *packed])


def _unpack_values(payload: bytes) -> np.ndarray:
    view = memoryview(payload)
    ends = np.cumsum([24, *np.frombuffer(view[:24], np.int64)]).tolist()
    count, total, own = (_unpack_numbers(view[i:j], kind) for i, j, kind in zip(ends[:-1], ends[1:], (np.int64, np.int64, np.float64), strict=True))
    out = np.empty(len(count))
    out[count == 0] = own
    out[count > 0] = _ratio(count[count > 0], total[count > 0])
    return out


def _ratio(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.log10((2 * count - 1) / np.maximum(2 * total, 1).astype(float))


def _by_part(keys: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, index of its keys in their order) of sorted keys."""
    suffix = (keys >> np.uint64(8)) & np.uint64((1 << (8 * (SHARED + 1))) - 1)
    part = (mix(suffix) % np.uint64(parts)).astype(np.min_scalar_type(parts))
    order = np.argsort(part, kind="stable")
    first = group_runs(part[order])
    for i, j in zip(first.tolist(), np.append(first[1:], len(order)).tolist(), strict=True):
        yield int(part[order[i]]), order[i:j]


def key_counts(training: DataFrame, text: str, parts: int, across: bool) -> DataFrame:
    """(part, keys, counts): every key of the training texts with its count, one row per part."""

    def run(batches):
        for batch in batches:
            for part_of_batch in sliced([batch], 0):
                found = [np.unique(keys, return_counts=True) for keys in _text_keys(part_of_batch.column(0), across)]
                keys, n = _sum_equal(*(np.concatenate(x) for x in zip(*found, strict=True)))
                rows = [(part, _pack_numbers(keys[at]), _pack_numbers(n[at])) for part, at in _by_part(keys, parts)]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "keys", "counts"])

    def merge(table: pa.Table) -> pa.Table:
        keys = np.concatenate([_unpack_numbers(x.as_buffer(), np.uint64) for x in table.column("keys")])
        n = np.concatenate([_unpack_numbers(x.as_buffer(), np.int64) for x in table.column("counts")])
        keys, n = _sum_equal(keys, n)
        columns = [table.column("part").slice(0, 1), pa.array([_pack_numbers(keys)], pa.binary()), pa.array([_pack_numbers(n)], pa.binary())]
        return pa.table(columns, names=["part", "keys", "counts"])

    shape = "part int, keys binary, counts binary"
    listed = training.select(training[text].alias("text")).mapInArrow(run, shape)
    return listed.groupBy("part").applyInArrow(merge, shape)


def _pairs(keys: np.ndarray, n: np.ndarray, orders: Iterable[int]) -> tuple[np.ndarray, np.ndarray]:
    """(pair, count) of the given orders, longest first; pair = context key * 256 + symbol."""
    found = [(keys[:0], n[:0])]
    for k in orders:
        keys, n = _sum_equal(keys & np.uint64((1 << (8 * (k + 1))) - 1), n)
        found.append((keys | np.uint64((k + 1) << 56), n))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def shared_pairs(counts: DataFrame, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(pair, count) of all orders up to ``SHARED``, from ``training_counts``."""
    summed = counts.filter("pair is not null").select("pair", "n").toArrow()
    pairs, n = summed.column("pair").to_numpy().view(np.uint64), summed.column("n").to_numpy()
    return _pairs(pairs, n, range(min(order, SHARED), -1, -1))


@dataclass
class Trie:
    """Sorted arrays: pairs with counts; contexts with totals, and the same for their suffix without their symbols."""

    order: int
    pairs: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    total: np.ndarray
    distinct: np.ndarray
    lost: np.ndarray
    rest_total: np.ndarray
    rest_distinct: np.ndarray

    @classmethod
    def build(cls, order: int, pairs: np.ndarray, counts: np.ndarray, contexts_lost: np.ndarray = _NONE, lost: np.ndarray = _NO_COUNTS) -> Trie:
        """``lost`` has the count of each of ``contexts_lost`` (sorted) that is not among the pairs."""
        at = np.argsort(pairs)
        pairs, counts = pairs[at], counts[at]
        contexts = pairs >> np.uint64(8)
        first = group_runs(contexts)
        contexts = contexts[first]
        sizes = np.diff(np.append(first, len(pairs)))
        total = np.add.reduceat(counts, first) if len(first) else counts[:0]
        # A pair's suffix: one byte less of context, the same symbol.
        k = (pairs >> np.uint64(56)).astype(np.int64) - 1
        body = pairs & np.uint64((1 << 56) - 1)
        mask = np.where(k > 0, np.uint64(256) ** np.maximum(k, 0).astype(np.uint64) - np.uint64(1), np.uint64(0))
        suffix = (np.maximum(k, 0).astype(np.uint64) << np.uint64(56)) | (body & mask)
        where = np.minimum(np.searchsorted(pairs, suffix), max(len(pairs) - 1, 0))
        seen = np.where((k > 0) & (pairs[where] == suffix), counts[where], 0) if len(pairs) else counts
        excluded = np.add.reduceat(seen, first) if len(first) else seen
        k_context = (contexts >> np.uint64(48)).astype(np.int64) - 1
        mask = np.where(k_context > 0, np.uint64(256) ** np.maximum(k_context - 1, 0).astype(np.uint64) - np.uint64(1), np.uint64(0))
        parent = (np.maximum(k_context, 0).astype(np.uint64) << np.uint64(48)) | (contexts & np.uint64((1 << 48) - 1) & mask)
        up = np.minimum(np.searchsorted(contexts, parent), max(len(contexts) - 1, 0))
        known = (k_context > 0) & (contexts[up] == parent) if len(contexts) else np.zeros(0, bool)
        rest_total = np.where(known, total[up] - excluded, 0)
        rest_distinct = np.where(known, sizes[up] - sizes, 0)
        own = np.minimum(np.searchsorted(contexts_lost, contexts), max(len(contexts_lost) - 1, 0))
        cut = np.where(contexts_lost[own] == contexts, lost[own], 0) if len(lost) else np.zeros(len(contexts), np.int64)
        return cls(order, pairs, counts, contexts, total, sizes, cut, rest_total, rest_distinct)

    def log10_of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(count, total, log10 probability) of the last byte of each key after the others; a count of 0 says that the
        longest context does not give the probability alone."""
        return self._coded((keys & np.uint64(255)).astype(np.uint8), keys >> np.uint64(8), np.full(len(keys), CONTEXT))

    def _log10(self, symbol: np.ndarray, context: np.ndarray, place: np.ndarray) -> np.ndarray:
        return self._coded(symbol, context, place)[2]

    def _coded(self, symbol: np.ndarray, context: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(symbol)
        out, open_, above = np.zeros(n), np.ones(n, bool), np.full(n, -1)
        count_of, total_of = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for k in range(self.order, -1, -1):
            index = np.flatnonzero(open_ & (place >= k))
            if not len(index) or not len(self.contexts):
                continue
            keys = _context_keys(context[index], k)
            node = np.minimum(np.searchsorted(self.contexts, keys), len(self.contexts) - 1)
            known = self.contexts[node] == keys
            index, node, keys = index[known], node[known], keys[known]
            higher = above[index]
            total = np.where(higher >= 0, self.rest_total[higher], self.total[node])
            distinct = np.where(higher >= 0, self.rest_distinct[higher], self.distinct[node])
            pair = (keys << np.uint64(8)) | symbol[index]
            where = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            hit = self.pairs[where] == pair
            escape = distinct + 2 * self.lost[node]
            mass = np.maximum(2 * (total + self.lost[node]), 1).astype(float)
            count = self.counts[where[hit]]
            if k == self.order:
                count_of[index[hit]], total_of[index[hit]] = count, (total + self.lost[node])[hit]
            out[index[hit]] += np.log10((2 * count - 1) / mass[hit])
            miss = ~hit & (escape > 0)
            out[index[miss]] += np.log10(escape[miss] / mass[miss])
            open_[index[hit]] = False
            above[index] = node
        left = np.flatnonzero(open_)
        seen = np.where(above[left] >= 0, self.distinct[above[left]], 0) if len(self.contexts) else np.zeros(len(left))
        out[left] -= np.log10(np.maximum(_ALPHABET - seen, 1))
        return count_of, total_of, out


def key_scores(blocks: DataFrame, table: DataFrame | None, shared: tuple[np.ndarray, np.ndarray], parts: int, order: int, across: bool) -> DataFrame:
    """(block, words, vals): the distinct keys of every block of texts, by part, and their log10 probabilities.

    ``table`` has the counts of the training texts (``key_counts``). Without it, the column before the text says which
    rows of the blocks are the training texts, and the keys travel with their counts in those.
    """

    flagged = table is None

    def counted_keys(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        trained = rows.column(rows.num_columns - 2).to_numpy().astype(bool) if flagged else None
        keys, times, start = [], [], 0
        for _, n, piece in pieces(rows.column("text")):
            found, text = coded_keys(piece, Words(piece, NOT_SPACE, True), across)
            # One sort of the keys with a bit below that says whether the text is trained on.
            found <<= np.uint64(1)
            if trained is not None:
                found |= trained[start:n].astype(np.uint64)[text]
            start = n
            found.sort()
            bit, own = found & np.uint64(1), found >> np.uint64(1)
            first = group_runs(own)
            keys.append(own[first])
            times.append(np.add.reduceat(bit, first).astype(np.int64) if len(first) else _NO_COUNTS)
        return _sum_equal(np.concatenate(keys), np.concatenate(times))

    def list_keys(batches):
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys, n = counted_keys(unpack(payload.as_buffer()))
                rows = [(block, part, _pack_numbers(keys[at]), _pack_numbers(n[at])) for part, at in _by_part(keys, parts)]
                types = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "part", "words", "counts"])

    def unpacked(column: pa.ChunkedArray, kind: type) -> list[np.ndarray]:
        return [_unpack_numbers(x.as_buffer(), kind) for x in column]

    def look_up(asked: pa.Table, side: pa.Table | None = None) -> pa.Table:
        if not asked.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.binary(), pa.binary())], names=["block", "words", "vals"])
        lists, counts = unpacked(asked.column("words"), np.uint64), unpacked(asked.column("counts"), np.int64)
        distinct, n = _sum_equal(np.concatenate(lists), np.concatenate(counts))
        known, times = distinct[n > 0], n[n > 0]
        if side is not None:
            known = np.concatenate([_NONE, *unpacked(side.column("keys"), np.uint64)])
            times = np.concatenate([_NO_COUNTS, *unpacked(side.column("counts"), np.int64)])
        own = _pairs(known, times, range(order, SHARED, -1))
        trie = Trie.build(order, *(np.concatenate(x) for x in zip(shared, own, strict=True)))
        found = trie.log10_of(distinct)
        packed = []
        for keys in lists:
            at = np.searchsorted(distinct, keys)
            packed.append(_pack_values(*[x[at] for x in found]))
        return pa.table([asked.column("block"), asked.column("words"), pa.array(packed, pa.binary())], names=["block", "words", "vals"])

    shape = "block long, words binary, vals binary"
    listed = blocks.mapInArrow(list_keys, "block long, part int, words binary, counts binary").groupBy("part")
    if flagged:
        return listed.applyInArrow(lambda asked: look_up(asked), shape)
    return listed.cogroup(table.groupBy("part")).applyInArrow(lambda asked, side: look_up(asked, side), shape)


_TRAINED = "__trained"
_FIELDS = ("n_tokens", "n_known", "train_tokens")


def score_texts(
    docs: DataFrame, training: DataFrame | Column, text: str = "text", order: int = ORDER, keep: Sequence[str] | None = None, across: bool = False
) -> DataFrame:
    """Add n_tokens, n_known, train_tokens, base_score (smoothed unigrams) and score (partial matching).

    ``training`` is a frame, or says which rows of ``docs`` are trained on; their contexts are counted only once then.
    """
    inside = isinstance(training, Column)
    condition, training = (training, docs.filter(training)) if inside else (None, training)
    counted = materialize(training_counts(training, text, order, across))
    counts = counted.filter("word is not null").select("word", "n")
    shared = shared_pairs(counted, order)
    ends = training.count()
    words, tokens = counts.agg(F.count(F.lit(1)), F.sum("n")).first()
    tokens = (tokens or 0) + ends
    distinct = words + (ends > 0)
    size = training.agg(F.sum(F.octet_length(training[text])).alias("n")).first()["n"] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    table = None if inside else materialize(key_counts(training, text, parts, across))
    mass = tokens + 0.1 * (distinct + 1)
    end_base = float(np.log10((ends + 0.1) / mass))

    def words_of(texts: pa.ChunkedArray) -> Iterable[str]:
        return distinct_words(texts)[0]

    def values_of(words: list[str], known: dict[str, object]) -> list[bytes]:
        n = np.array([known.get(w, 0) for w in words], np.float64)
        values = np.stack([np.log10((n + 0.1) / mass), n], axis=1)
        return [row.tobytes() for row in values]

    def combine(texts: pa.ChunkedArray, words: list[str], values: list[bytes], listed: Sequence[tuple[bytes, bytes]]) -> Sequence:
        data, offsets = text_bytes(pa.array(words, pa.string()))
        word_index = _Index(span_hashes(data, offsets[:-1], offsets[1:]))
        base, n = np.frombuffer(b"".join(values)).reshape(-1, 2)[word_index.order].T
        key_index = _Index(np.concatenate([_NONE, *[_unpack_numbers(k, np.uint64) for k, _ in listed]]))
        coded_value = np.concatenate([np.zeros(0), *[_unpack_values(v) for _, v in listed]])[key_index.order]
        found_in = []
        for _, _, piece in pieces(texts):
            found = Words(piece, NOT_SPACE, True)
            at = word_index.places(found.hashes, "a word")
            seen, base_sum = (np.bincount(found.text, x[at], minlength=piece.n) for x in (n > 0, base))
            keys, text = coded_keys(piece, found, across)
            score = np.bincount(text, coded_value[key_index.places(keys, "a context")], minlength=piece.n)
            found_in.append((found.counts, seen.astype(np.int64), base_sum, score))
        counted, seen, base_sum, score = (np.concatenate(x) for x in zip(*found_in, strict=True))
        return [
            counted + 1,
            seen + int(ends > 0),
            np.full(len(counted), tokens, np.int64),
            base_sum + end_base,
            score,
        ]

    fields = [*[StructField(f, LongType()) for f in _FIELDS], StructField("base_score", DoubleType()), StructField("score", DoubleType())]
    keep = list(docs.columns if keep is None else keep)
    if inside:
        docs, keep = docs.withColumn(_TRAINED, F.coalesce(condition, F.lit(False))), [*keep, _TRAINED]
    scored = join_words(
        docs, text, words_of, values_of, combine, fields, keep, counts, BLOCK_BYTES, lambda blocks: key_scores(blocks, table, shared, parts, order, across)
    )
    return scored.drop(_TRAINED)
