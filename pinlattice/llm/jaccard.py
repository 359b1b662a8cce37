"""N-gram Jaccard join by partitioning the universe of tokens (pigeonhole principle).

A document is its set of distinct word shingles. Two documents link when their
Jaccard similarity is at least ``threshold``. Equal sets share a name (64 bits, made of
two independent sums) and are one class from then on.

Sets of sizes s <= t that link differ in at most
H = (1 - threshold) / (1 + threshold) * (s + t) tokens. Sizes are cut into bands of
ratio 1 / threshold, so a linking pair lies in one band or in two neighbours; a
set takes part in its own band (as the smaller one) and in the band below. Every
band hashes tokens into H + 1 segments: if no two segments of a pair could be
equal, the pair would differ in more than H tokens. So linking pairs share the hash
of at least one whole segment.

Allocation by cost: an empty segment (in bands with large segments, one of a
single token too) is nearly free of information and would put strangers together.
A set that has such segments leaves them all out, and for each of them gives
another segment (the cheapest: the one with the fewest tokens that has two more)
two units: there it also finds partners that differ by one token, through
one-deletion neighbourhoods. The units add up to the same sum, so the guarantee
stays; a set without enough segments to stand in leaves none out. Its own
deletions meet the whole segments of others; others' deletions are indexed only
where a filter of the asking segments lets them through (a fixed number of bits; a
full filter only costs time).

Which keys occur in two sets is learned from packed keys (eight bytes each, in blobs by
part of the hash range); only keys that do travel as rows.

Components: in a few rounds every bucket (equal segment hash) compares its members with
one representative, the same one in all buckets that hold it. Those that link join
the representative's component, and a bucket whose members are all in one component is
done. Members still in different components of a bucket are then all compared with each
other. So no link that could join two components is left out, and a group of n near
copies costs about n pairs. Links are then counted inside the components, all pairs of
each, in cells of two blocks of sets that give counts and never rows of pairs.
``jaccard_links`` gives the links themselves: every pair of different sets of a bucket is
compared, and its table is as large as the job, up to n * (n - 1) / 2 links for n near copies.

A pair is compared once whatever number of buckets it shares, unless the sizes, parity
sketches or counts by cell rule a link out (two sets differ in at least as many tokens as their
sketches differ in bits or counts; cells grow in number with the set). The rest is verified exactly, on the shingles themselves (64-bit hashes
of the words). Hot buckets are cut into a grid of cells, and a set's shingles move once
for each cell, not once for each pair.

Defined results: null texts and texts without words have an empty set, link with
nothing and are their own component; a text with fewer words than a shingle is one
shingle; repeated ids are one document for the components (the smallest id of a
component), each row is returned; a null id is never the smallest unless all of
the component are null. Columns named like a new one are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pinlattice.llm.batches import NOT_SPACE, Words, group_runs, mix, pieces, signed, text_bytes
from pinlattice.llm.decontaminate import bit_filter, passes
from pinlattice.llm.stored import stored
from pinlattice.operators.skew import spread_join
from pinlattice.session import materialize

FILTER_BITS = 1 << 24
# With so many tokens in a segment on average, one of a single token is left out as well.
LARGE_SEGMENT = 8
# Members of a bucket on a side of a cell of its pairs, and pairs of a cell of those left.
CELL_ROWS = 1000
CELL_PAIRS = 20_000
# So many hot keys at most are broadcast.
HOT_ROWS = 100_000
# Shingles of a side of a cell in which the links inside components are counted.
CELL_TOKENS = 1 << 20
# Rounds that compare buckets with a representative before all open pairs are compared.
REPRESENTATIVE_ROUNDS = 2
# Packed keys of a part of the hash range, about; the parts' number follows from the sets' sizes.
PART_KEYS = 1 << 20
# Longs of the parity sketch: bit h of a set is the parity of its tokens that hash to h.
SKETCH = 8
# Distinct pairs are compared on counts of tokens by cell before their shingles are: the largest count kept
# (half a byte), and cells of a step in memory.
MOST_COUNT = 15
STEP_CELLS = 1 << 20
_SKETCH_COLUMNS = [f"q{i}" for i in range(SKETCH)]


@dataclass(frozen=True)
class Rules:
    """Shingle length and the similarity as an exact fraction."""

    shingle: int
    numerator: int
    denominator: int

    @property
    def threshold(self) -> float:
        return self.numerator / self.denominator

    def bands(self) -> Bands:
        return Bands(self)


class Bands:
    """Size bands and their numbers of segments, made for any size on demand."""

    def __init__(self, rules: Rules):
        self.rules = rules
        self.lows = [1]
        self.segments: list[int] = []
        self.tiny: list[int] = []

    def _extend(self, size: int) -> None:
        n, d = self.rules.numerator, self.rules.denominator
        while self.lows[-1] <= size:
            low = self.lows[-1]
            # The band above starts beyond every partner of this band's smallest set ...
            high = max(low, low * d // n)
            self.lows.append(high + 1)
            # ... and its largest set has partners of at most this size.
            most = high + high * d // n
            self.segments.append((d - n) * most // (d + n) + 1)
            self.tiny.append(int(low >= LARGE_SEGMENT * self.segments[-1]))

    def of(self, sizes: np.ndarray) -> np.ndarray:
        self._extend(int(sizes.max(initial=1)) + 1)
        return np.searchsorted(self.lows, sizes, "right") - 1

    def count(self, bands: np.ndarray) -> np.ndarray:
        return np.array(self.segments, np.int64)[bands]


def shingle_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every distinct shingle, sorted by text; short texts are one shingle."""
    grams, at = words.grams(n)
    owner = words.text[at]
    for k in range(1, n):
        runs, first = words.grams(k)
        short = words.counts[words.text[first]] == k
        grams, owner = np.concatenate([grams, runs[short]]), np.concatenate([owner, words.text[first[short]]])
    keys = grams + mix(owner.astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys)
    first = np.sort(order[group_runs(keys[order])])
    grams, owner = grams[first], owner[first]
    if len(owner) and (owner[1:] < owner[:-1]).any():  # the short texts came last
        order = np.argsort(owner, kind="stable")
        grams, owner = grams[order], owner[order]
    return grams, owner


def _sums(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    np.add.at(out, owner, values)
    return out


def set_names(grams: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit name of each text's set: equal for equal sets, made of two sums and the size."""
    one = _sums(mix(grams + np.uint64(0xA5A5)), owner, n)
    two = _sums(mix(grams ^ np.uint64(0x5DEECE66D1234567)), owner, n)
    return mix(mix(one) ^ (two * np.uint64(3)) + np.bincount(owner, minlength=n).astype(np.uint64))


def parity_sketches(grams: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """``SKETCH`` longs of each text's set: a lower bound of the difference of two sets is that of their bits."""
    slot = mix(grams ^ np.uint64(0x0DD)) & np.uint64(64 * SKETCH - 1)
    out = np.zeros(n * SKETCH, np.uint64)
    place = owner * SKETCH + (slot >> np.uint64(6)).astype(np.int64)
    np.bitwise_xor.at(out, place, np.uint64(1) << (slot & np.uint64(63)))
    return out.reshape(n, SKETCH)


def cell_bits(sizes: np.ndarray) -> np.ndarray:
    """Cells of a set's counts, as a power of two that grows with the size: two to four tokens a cell, fewer in sets under 512; 16 at least, a whole word."""
    up = np.frexp(np.maximum(sizes, 1).astype(float))[1]  # 2 ** (up - 1) <= size < 2 ** up
    return np.maximum(np.clip(up + 1, 4, 8), up - 2)


def count_sketches(grams: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    """Each text's tokens counted by cell, two cells a byte: sets differ in at least as many tokens as their counts do.

    A cell is made of the first bits of a token's hash, so two neighbours add up to a cell of a sketch half as long.
    """
    bits = cell_bits(np.bincount(owner, minlength=n))
    cell = mix(grams ^ np.uint64(0x0DD)) >> (64 - bits[owner]).astype(np.uint64)
    ends = np.cumsum(1 << bits)
    offsets = np.concatenate(([0], ends))
    texts = np.searchsorted(owner, np.arange(n + 1))  # owners are sorted
    parts, i = [np.zeros(0, np.uint8)], 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, offsets[i] + STEP_CELLS, "right")))
        mine = slice(texts[i], texts[j])
        place = offsets[owner[mine]] - offsets[i] + cell[mine].astype(np.int64)
        counts = np.minimum(np.bincount(place, minlength=offsets[j] - offsets[i]), MOST_COUNT).astype(np.uint8)
        parts.append(counts[0::2] | counts[1::2] << 4)
        i = j
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((offsets // 2).astype(np.int32)), pa.py_buffer(np.concatenate(parts))])


def cell_counts(packed: np.ndarray, starts: np.ndarray, own: int, wanted: int) -> np.ndarray:
    """The sketches of 2 ** ``own`` cells that start at ``starts``, a line each of 2 ** ``wanted`` cells."""
    pairs = packed[starts[:, None] + np.arange(1 << own - 1)]
    out = np.empty((len(starts), 1 << own), np.int16)
    out[:, 0::2] = pairs & 15
    out[:, 1::2] = pairs >> 4
    return out if own == wanted else out.reshape(len(starts), 1 << wanted, -1).sum(axis=2, dtype=np.int16)


def word_differences(words: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """Sums of the differences of two rows of half bytes, ``width`` words each, that start at ``a`` and ``b``."""
    low, pairs = np.uint64(0x0F0F0F0F0F0F0F0F), np.uint64(0x00FF00FF00FF00FF)
    total = np.zeros(len(a), np.int64)
    for i in range(0, width, 8):  # a byte holds the sum of 16 differences of 15 at most
        place = np.arange(i, min(i + 8, width))
        x, y = words[a[:, None] + place], words[b[:, None] + place]
        differing = np.zeros(x.shape, np.uint64)
        for shift in (0, 4):
            p, q = (((v >> np.uint64(shift)) & low).view(np.uint8) for v in (x, y))
            differing += (np.maximum(p, q) - np.minimum(p, q)).view(np.uint64)
        sums = differing.sum(axis=1, dtype=np.uint64)
        sums = (sums & pairs) + ((sums >> np.uint64(8)) & pairs)
        total += ((sums * np.uint64(0x0001000100010001)) >> np.uint64(48)).astype(np.int64)
    return total


def least_differences(packed: np.ndarray, starts: np.ndarray, bits: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For every pair of sets (places ``a``, ``b``) a lower bound of the tokens they differ in."""
    out = np.zeros(len(a), np.int64)
    words = packed[: len(packed) // 8 * 8].view(np.uint64)
    kinds = bits[a].astype(np.int64) << 6 | bits[b]
    for kind in np.unique(kinds).tolist():
        of = np.flatnonzero(kinds == kind)
        x, y = kind >> 6, kind & 63
        wanted = min(x, y)
        step = max(1, STEP_CELLS >> max(x, y))
        for i in range(0, len(of), step):
            at = of[i : i + step]
            if x == y:
                out[at] = word_differences(words, starts[a[at]] // 8, starts[b[at]] // 8, 1 << x - 4)
                continue
            differing = cell_counts(packed, starts[a[at]], x, wanted)
            differing -= cell_counts(packed, starts[b[at]], y, wanted)
            out[at] = np.abs(differing, out=differing).sum(axis=1, dtype=np.int64)
    return out


def segment_keys(grams: np.ndarray, owner: np.ndarray, n: int, bands: Bands, asking: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """All of ``keys_by_band`` at once."""
    keys, texts = zip(*keys_by_band(grams, owner, n, bands, asking), strict=True)
    return np.concatenate(keys), np.concatenate(texts)


def keys_by_band(grams: np.ndarray, owner: np.ndarray, n: int, bands: Bands, asking: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(key, text) of every bucket each text is in, a band at a time.

    ``asking`` None gives only the keys of segments with two units (what the filter
    is made of); else it is that filter.
    """
    sizes = np.bincount(owner, minlength=n)
    own = bands.of(np.maximum(sizes, 1))
    for shift in (0, 1):
        band = own - shift
        # A set takes part in the band below only if its smallest partner can lie there.
        part = (sizes > 0) & (band >= 0)
        if shift:
            smallest = -(-sizes * bands.rules.numerator // bands.rules.denominator)
            part &= bands.of(np.maximum(smallest, 1)) <= band
        taking = part[owner]
        g, o = grams[taking], owner[taking]
        m = np.where(part, bands.count(np.maximum(band, 0)), 0)
        first = np.concatenate(([0], np.cumsum(m)))
        scatter = mix(g + np.uint64(0x51ED))
        segment = ((scatter >> np.uint64(32)) * m[o].astype(np.uint64)) >> np.uint64(32)
        place = first[o] + segment.astype(np.int64)
        token = mix(g ^ np.uint64(0xC0FFEE))
        total = _sums(token, place, first[-1])
        filled = np.bincount(place, minlength=first[-1])
        text = np.repeat(np.arange(n), m)
        salt = mix((band[text] + 1).astype(np.uint64) * np.uint64(1 << 32) + (np.arange(first[-1]) - first[text]).astype(np.uint64))
        least = np.array(bands.tiny, np.int64)[np.maximum(band, 0)][text]
        tiny, able = filled <= least, filled >= least + 2
        need = np.bincount(text[tiny], minlength=n)
        need[need > np.bincount(text[able], minlength=n)] = 0
        left_out = tiny & (need[text] > 0)
        double = able & (need[text] > 0)
        double &= _rank(text, double, filled) < need[text]
        whole = mix(total + salt)
        if asking is None:
            yield whole[double], text[double]
            continue
        yield whole[~left_out], text[~left_out]
        without = mix(total[place] - token + salt[place])
        may = double[place] | passes(asking, without)
        yield without[may], o[may]


def _rank(text: np.ndarray, chosen: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Rank of each chosen entry within its text by cost, then place; others get a huge rank."""
    out = np.full(len(text), np.iinfo(np.int64).max)
    at = np.flatnonzero(chosen)
    at = at[np.lexsort((at, cost[at], text[at]))]
    starts = group_runs(text[at])
    out[at] = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
    return out


def _sets(batch: pa.RecordBatch, column: int, n: int):
    """(first row, row count, shingles, owners, set names) of the texts of a batch."""
    for i, j, piece in pieces(batch.column(column)):
        grams, owner = shingle_sets(Words(piece, NOT_SPACE, True), n)
        yield i, j - i, grams, owner, set_names(grams, owner, j - i)


def _lists(values: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    order = np.argsort(owner, kind="stable")
    offsets = np.searchsorted(owner[order], np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(values[order])))


def set_table(source: DataFrame, rules: Rules) -> DataFrame:
    """(id, text_key, n_shingles, set, asks, parity sketches, counts by cell) of every row (id, text, text_key): ``asks`` are the keys of its segments with two units."""

    def run(batches):
        bands = rules.bands()
        for batch in batches:
            for i, n, grams, owner, names in _sets(batch, 1, rules.shingle):
                sizes = np.bincount(owner, minlength=n)
                asks = _lists(*segment_keys(grams, owner, n, bands, None), n)
                columns = [batch.column(0).slice(i, n), batch.column(2).slice(i, n), pa.array(sizes), pa.array(signed(names), mask=sizes == 0), asks]
                columns += [pa.array(signed(np.ascontiguousarray(q))) for q in parity_sketches(grams, owner, n).T]
                columns.append(count_sketches(grams, owner, n))
                yield pa.RecordBatch.from_arrays(columns, names=["id", "text_key", "n_shingles", "set", "asks", *_SKETCH_COLUMNS, "counts"])

    sketch = ", ".join(f"{c} long" for c in _SKETCH_COLUMNS)
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, text_key long, n_shingles long, set long, asks array<long>, {sketch}, counts binary")


def _bucket_batches(batches, rules: Rules, asking: np.ndarray, parts: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(part, rest, set) of the keys of all texts, a piece and a band at a time; equal sets of a piece only once."""
    bands = rules.bands()
    for batch in batches:
        for _, n, grams, owner, names in _sets(batch, 1, rules.shingle):
            once = np.zeros(n, bool)
            once[np.unique(names, return_index=True)[1]] = True
            grams, owner = grams[once[owner]], owner[once[owner]]
            for keys, at in keys_by_band(grams, owner, n, bands, asking):
                yield (keys >> np.uint64(32)) % np.uint64(parts), keys.astype(np.uint32), names[at]


def repeated_keys(source: DataFrame, rules: Rules, asking: np.ndarray, parts: int) -> DataFrame:
    """(key) of every bucket of two different sets; a key is its part of the hash range and 32 bits more.

    Keys travel packed, each with 32 bits of a set's name that tell different sets from
    copies of one. Of a piece with many sets in a bucket the smallest and the largest
    bits are enough. A false match of keys only costs a comparison; two different sets
    of a bucket without a third are told apart but for one case in 2^32.
    """

    def pack(batches):
        for part, rest, names in _bucket_batches(batches, rules, asking, parts):
            if not len(names):
                continue
            key = (part << np.uint64(32)) | rest
            order = np.argsort(key)
            key, tags = key[order], (names[order] >> np.uint64(32)).astype(np.uint32)
            first = group_runs(key)
            key, least, most = key[first], np.minimum.reduceat(tags, first), np.maximum.reduceat(tags, first)
            several = least != most
            key, tags = np.concatenate([key, key[several]]), np.concatenate([least, most[several]])
            order = np.argsort(key, kind="stable")
            key, tags = key[order], tags[order]
            part, rest = key >> np.uint64(32), key.astype(np.uint32)
            starts = group_runs(part)
            blobs = [rest[i:j].tobytes() + tags[i:j].tobytes() for i, j in zip(starts.tolist(), np.append(starts[1:], len(part)).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(part[starts].astype(np.int64)), pa.array(blobs, pa.binary())], names=["part", "blob"])

    def twice(table: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(blob.as_buffer(), np.uint32) for blob in table.column("blob")]
        rest = np.concatenate([blob[: len(blob) // 2] for blob in blobs])
        tags = np.concatenate([blob[len(blob) // 2 :] for blob in blobs])
        order = np.argsort(rest, kind="stable")
        rest, tags = rest[order], tags[order]
        first = group_runs(rest)
        several = np.minimum.reduceat(tags, first) != np.maximum.reduceat(tags, first)
        key = (np.int64(table.column("part")[0].as_py()) << np.int64(32)) | rest[first[several]].astype(np.int64)
        return pa.table([pa.array(key)], names=["key"])

    return source.mapInArrow(pack, "part long, blob binary").groupBy("part").applyInArrow(twice, "key long")


def bucket_keys(source: DataFrame, rules: Rules, asking: np.ndarray, parts: int, wanted: np.ndarray) -> DataFrame:
    """(key, set) of all texts that ``wanted`` lets through."""

    def run(batches):
        for part, rest, names in _bucket_batches(batches, rules, asking, parts):
            keys = (part << np.uint64(32)) | rest
            may = passes(wanted, keys)
            yield pa.RecordBatch.from_arrays([pa.array(signed(keys[may])), pa.array(signed(names[may]))], names=["key", "set"])

    return source.mapInArrow(run, "key long, set long")


def shingle_arrays(source: DataFrame, rules: Rules, active: np.ndarray) -> DataFrame:
    """(set, shingles) of the sets that the filter ``active`` lets through, once each."""

    def run(batches):
        for batch in batches:
            for _, n, grams, owner, names in _sets(batch, 1, rules.shingle):
                use = np.zeros(n, bool)
                use[np.unique(names, return_index=True)[1]] = True
                use &= passes(active, names) & (np.bincount(owner, minlength=n) > 0)
                lists = _lists(grams, owner, n).filter(pa.array(use))
                yield pa.RecordBatch.from_arrays([pa.array(signed(names)[use]), lists], names=["set", "shingles"])

    found = source.mapInArrow(run, "set long, shingles array<long>")
    return found.groupBy("set").agg(F.first("shingles").alias("shingles"))


def in_cells(pairs: DataFrame, sets: DataFrame, compute: Callable[[np.ndarray, np.ndarray, pa.Table, pa.Table], pa.Table], shape: str) -> DataFrame:
    """``compute`` over all distinct pairs (key, a, b) in cells; ``sets`` has a row for each set.

    ``compute`` gets the places of a and b in the cell's rows of ``sets``, sorted by a, those rows and the pairs.
    """
    per_key = pairs.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    hot = per_key.filter(F.col("n") > CELL_PAIRS).select("key", F.ceil(F.sqrt(F.col("n") / CELL_PAIRS)).cast("int").alias("side"))
    total = pairs.count()
    # A hot key has more than CELL_PAIRS pairs, so they are few; sent to all tasks, the pairs move once, to their cells.
    hot = F.broadcast(hot) if total // CELL_PAIRS <= HOT_ROWS else hot
    parts = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // CELL_PAIRS))
    side = F.coalesce("side", F.lit(1))
    salts = [F.pmod(F.xxhash64(c, F.lit(7)), side) for c in ("a", "b")]
    cells = pairs.join(hot, "key", "left").select(F.pmod(F.xxhash64("key", *salts), F.lit(parts)).alias("cell"), "key", "a", "b")
    wanted = cells.select("cell", F.col("a").alias("set")).union(cells.select("cell", F.col("b").alias("set"))).distinct()
    placed = wanted.withColumnRenamed("cell", "place").join(sets, "set")

    def run(table: pa.Table, side: pa.Table) -> pa.Table:
        names = side.column("set").to_numpy()
        order = np.argsort(names)
        a, b = (np.searchsorted(names, table.column(c).to_numpy(), sorter=order) for c in ("a", "b"))
        a, b = order[a], order[b]
        by_a = np.argsort(a, kind="stable")
        return compute(a[by_a], b[by_a], side, table.take(pa.array(by_a)))

    return cells.groupBy("cell").cogroup(placed.groupBy("place")).applyInArrow(run, shape)


def still_open(pairs: DataFrame, sketches: DataFrame, rules: Rules) -> DataFrame:
    """The pairs (key, a, b) whose sizes and counts by cell leave room for a link; no shingles are moved for the others."""
    n, d = rules.numerator, rules.denominator

    def compute(a: np.ndarray, b: np.ndarray, side: pa.Table, table: pa.Table) -> pa.Table:
        size = side.column("size").to_numpy()
        alike = np.minimum(size[a], size[b]) * d >= np.maximum(size[a], size[b]) * n
        packed, offsets = text_bytes(side.column("counts"))
        a, b, table = a[alike], b[alike], table.filter(pa.array(alike))
        differing = least_differences(packed, offsets[:-1], cell_bits(size), a, b)
        return table.select(["key", "a", "b"]).filter(pa.array(differing * (d + n) <= (size[a] + size[b]) * (d - n)))

    return in_cells(pairs, sketches.select("set", "size", "counts"), compute, "key long, a long, b long")


def verify(pairs: DataFrame, shingles: DataFrame, rules: Rules) -> DataFrame:
    """(set_a, set_b, common, union) of the distinct pairs (key, a, b) that link, by the exact intersection of their sets."""

    def compute(a: np.ndarray, b: np.ndarray, side: pa.Table, table: pa.Table) -> pa.Table:
        column = side.column("shingles").combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
        values = np.unique(column.flatten().to_numpy(), return_inverse=True)[1]
        bounds = np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy(), dtype=np.int64)))
        size = np.diff(bounds)
        seen = np.zeros(int(values.max(initial=0)) + 1, bool)
        common = np.zeros(len(a), np.int64)
        first = group_runs(a)
        for i, j in zip(first.tolist(), np.append(first[1:], len(a)).tolist(), strict=True):
            own = values[bounds[a[i]] : bounds[a[i] + 1]]
            seen[own] = True
            for at in range(i, j):
                common[at] = np.count_nonzero(seen[values[bounds[b[at]] : bounds[b[at] + 1]]])
            seen[own] = False
        union = size[a] + size[b] - common
        out = pa.table([table.column("a"), table.column("b"), pa.array(common), pa.array(union)], names=["set_a", "set_b", "common", "union"])
        return out.filter(pa.array(common * rules.denominator >= union * rules.numerator))

    return in_cells(pairs, shingles, compute, "set_a long, set_b long, common long, union long")


def components(links: DataFrame, random_names: bool = False, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b): nodes of one component share a root.

    Every round contracts each node to its neighbour of the smallest random rank, so
    chains of any order shrink by a constant factor a round. ``random_names`` says
    that the nodes' values are hashes; they are the ranks then, which settles a star
    around its smallest member at once. All rounds are one plan, compiled once.
    Steps are tables: a checkpoint would hand the conditions of all earlier rounds on to
    the optimizer, which combines them.
    """
    spark = links.sparkSession
    edges = stored(links.select("a", "b").filter("a <> b").distinct(), "edges")
    steps: list[DataFrame] = []

    def rank(node: Column) -> Column:
        return F.struct((node if random_names else F.xxhash64(node)).alias("rank"), node.alias("node"))

    while not edges.isEmpty():
        if len(steps) == rounds:
            raise RuntimeError("components did not shrink")
        both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        best = both.groupBy("a").agg(F.min(rank(F.col("b"))).alias("n"))
        step = stored(best.select(F.col("a").alias("node"), F.least(F.col("n"), rank(F.col("a")))["node"].alias("to")), "step")
        steps.append(step)
        moved = edges.join(step.select(F.col("node").alias("a"), F.col("to").alias("a2")), "a")
        moved = moved.join(step.select(F.col("node").alias("b"), F.col("to").alias("b2")), "b")
        moved = moved.filter("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct()
        edges = stored(moved, "edges")
    if not steps:
        return spark.createDataFrame([], "node long, root long")
    out = steps[-1].select("node", F.col("to").alias("root"))
    for step in reversed(steps[:-1]):
        later = out.select(F.col("node").alias("__node"), "root")
        # What a step leads to is settled by the later steps, unless it vanished there.
        out = step.join(later, step["to"] == later["__node"], "left").select("node", F.coalesce("root", "to").alias("root"))
    return stored(out, "components")


def may_link(rules: Rules, left: str, right: str) -> Column:
    """Whether sizes and parity sketches (columns with the given suffixes) leave room for a link."""
    n, d = rules.numerator, rules.denominator
    a, b = F.col(f"size{left}"), F.col(f"size{right}")
    differing = sum((F.bit_count(F.col(q + left).bitwiseXOR(F.col(q + right))) for q in _SKETCH_COLUMNS), F.lit(0))
    return (F.least(a, b) * d >= F.greatest(a, b) * n) & (differing * (d + n) <= (a + b) * (d - n))


def _keys_of(df: DataFrame) -> DataFrame:
    return df.select(F.col("a").alias("set")).union(df.select(F.col("b").alias("set")))


class Candidates:
    """The members of all buckets, and the exact comparison of pairs of them."""

    def __init__(self, source: DataFrame, rows: DataFrame, rules: Rules, filter_bits: int = FILTER_BITS):
        self.source, self.rules, self.filter_bits = source, rules, filter_bits
        asking = bit_filter(rows.select(F.explode("asks").alias("key")), "key", filter_bits)
        tokens = rows.agg(F.sum("n_shingles")).first()[0] or 0
        least = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        parts = max(least, -(-tokens // PART_KEYS))
        buckets = materialize(repeated_keys(source, rules, asking, parts))
        wanted = bit_filter(buckets, "key", filter_bits)
        found = bucket_keys(source, rules, asking, parts, wanted).join(buckets, "key").distinct()
        one_each = [F.first("n_shingles").alias("size"), *[F.first(c).alias(c) for c in (*_SKETCH_COLUMNS, "counts")]]
        self.sketches = rows.filter("set is not null").groupBy("set").agg(*one_each)
        # A set is in many buckets: sizes and sketches stay with the sets until pairs of few members are made.
        self.members = stored(found, "members").withColumn("component", F.col("set"))

    @staticmethod
    def side(members: DataFrame, suffix: str) -> DataFrame:
        return members.select("key", *[F.col(c).alias(c + suffix) for c in members.columns if c != "key"])

    def all_pairs(self) -> DataFrame:
        """All pairs of different components that share a bucket, as (a, b), a < b, and a bucket of theirs."""
        members = stored(self.members.join(self.sketches.drop("counts"), "set"), "members")
        met = spread_join(self.side(members, "_a"), self.side(members, "_b"), ["key"], CELL_ROWS).filter((F.col("set_a") < F.col("set_b")) & (F.col("component_a") != F.col("component_b")) & may_link(self.rules, "_a", "_b"))
        return self.once(met)

    def representative_pairs(self, round_: int) -> DataFrame:
        """Every member of a bucket with the bucket's representative of the round; at most as many pairs as members."""
        chosen = self.side(self.members, "_a").groupBy("key").agg(F.min_by(F.struct("set_a", "component_a"), F.xxhash64("set_a", F.lit(round_))).alias("r"))
        met = spread_join(self.side(self.members, "_b"), chosen.select("key", "r.*"), ["key"])
        return self.once(met.filter(F.col("component_a") != F.col("component_b")))

    @staticmethod
    def once(met: DataFrame) -> DataFrame:
        pairs = met.groupBy(F.least("set_a", "set_b").alias("a"), F.greatest("set_a", "set_b").alias("b"))
        return materialize(pairs.agg(F.min("key").alias("key")).select("key", "a", "b"))

    def links(self, pairs: DataFrame) -> DataFrame:
        """(set_a, set_b, common, union) of the pairs that link."""
        open_ = materialize(still_open(pairs, self.sketches, self.rules))
        active = bit_filter(_keys_of(open_), "set", self.filter_bits)
        shingles = materialize(shingle_arrays(self.source, self.rules, active))
        return materialize(verify(open_, shingles, self.rules))

    def join_components(self, roots: DataFrame) -> None:
        """Give every member its component (node, root); buckets of a single component are done."""
        placed = self.members.drop("component").join(roots.withColumnRenamed("node", "set"), "set", "left")
        placed = placed.withColumn("component", F.coalesce("root", "set")).drop("root")
        several = placed.groupBy("key").agg(F.min("component").alias("__least"), F.max("component").alias("__last")).filter("__least <> __last").select("key")
        self.members = stored(placed.join(several, "key").select(*self.members.columns), "members")


def link_sets(source: DataFrame, rows: DataFrame, rules: Rules, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(set_a, set_b, common, union) of all different sets that link, set_a < set_b; ``source`` has (id, text), ``rows`` its set table."""
    candidates = Candidates(source, rows, rules, filter_bits)
    return candidates.links(candidates.all_pairs())


def joining_links(source: DataFrame, rows: DataFrame, rules: Rules, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(node, root) of all sets that link: the components of all links, found without making all of them."""
    candidates = Candidates(source, rows, rules, filter_bits)
    found = None
    for round_ in range(REPRESENTATIVE_ROUNDS + 1):
        last = round_ == REPRESENTATIVE_ROUNDS
        pairs = candidates.all_pairs() if last else candidates.representative_pairs(round_)
        new = candidates.links(pairs).select(F.col("set_a").alias("a"), F.col("set_b").alias("b"))
        found = new if found is None else found.union(new)
        roots = components(found, random_names=True)
        if not last:
            candidates.join_components(roots)
    return roots


def links_within(values: np.ndarray, bounds: np.ndarray, left: np.ndarray, right: np.ndarray, rules: Rules) -> np.ndarray:
    """Links of every set with others, by exact intersections; ``left`` and ``right`` are the same places or have none in common.

    Set i has the distinct tokens ``values[bounds[i] : bounds[i + 1]]``, small numbers, and at least one.
    """
    n, d = rules.numerator, rules.denominator
    size = np.diff(bounds)
    found = np.zeros(len(size), np.int64)
    same = np.array_equal(left, right)
    right = right[np.argsort(size[right], kind="stable")]
    left = right if same else left
    sizes = size[right]
    tokens = np.concatenate([values[bounds[b] : bounds[b + 1]] for b in right.tolist()])
    starts = np.concatenate(([0], np.cumsum(sizes)))
    # Partners of a set lie in a range of sizes, and tokens are in order of sizes.
    low = np.arange(1, len(left) + 1) if same else np.searchsorted(sizes * d, size[left] * n, "left")
    high = np.searchsorted(sizes * n, size[left] * d, "right")
    seen = np.zeros(int(values.max(initial=0)) + 1, np.uint8)
    for a, i, j in zip(left.tolist(), low.tolist(), high.tolist(), strict=True):
        if i >= j:
            continue
        own = values[bounds[a] : bounds[a + 1]]
        seen[own] = 1
        common = np.add.reduceat(seen[tokens[starts[i] : starts[j]]], starts[i:j] - starts[i], dtype=np.int64)
        seen[own] = 0
        links = common * d >= (size[a] + sizes[i:j] - common) * n
        found[a] += np.count_nonzero(links)
        found[right[i:j][links]] += 1
    return found


def link_counts(source: DataFrame, rows: DataFrame, roots: DataFrame, rules: Rules, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(set, n_links): the number of other sets that link with each set of ``roots`` (node, root), all counted.

    A link never leaves a component, so all pairs of a component are compared, once each: its sets are
    dealt to blocks, a cell holds two blocks, and only counts leave it. No pair becomes a row, and what a
    task holds is bounded by rows and shingles of a cell, however many near copies there are.
    """
    sizes = rows.filter("set is not null").groupBy("set").agg(F.first("n_shingles").alias("size"))
    members = materialize(roots.join(sizes, roots["node"] == sizes["set"]).select("root", "set", "size"))
    side = F.greatest(F.ceil(F.count(F.lit(1)) / CELL_ROWS), F.ceil(F.sum("size") / CELL_TOKENS)).cast("int")
    sides = members.groupBy("root").agg(side.alias("side"))
    blocks = members.join(sides, "root").withColumn("block", F.pmod(F.xxhash64("set", F.lit(11)), "side").cast("int"))
    placed = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("side") - 1)))
    placed = placed.select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "set", "size")
    moved = placed.agg(F.sum("size")).first()[0] or 0
    parts = max(int(source.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-moved // CELL_TOKENS))
    active = bit_filter(members, "set", filter_bits)
    cells = placed.drop("size").withColumn("cell", F.pmod(F.xxhash64("root", "i", "j"), F.lit(parts)))
    cells = cells.join(shingle_arrays(source, rules, active), "set")

    def run(table: pa.Table) -> pa.Table:
        root, i, j, block = (table.column(c).to_numpy() for c in ("root", "i", "j", "block"))
        column = table.column("shingles").combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
        values = np.unique(column.flatten().to_numpy(), return_inverse=True)[1]
        bounds = np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy(), dtype=np.int64)))
        order = np.lexsort((j, i, root))
        changes = np.flatnonzero((np.diff(root[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)) + 1
        found, number = np.zeros(len(root), np.int64), np.zeros(len(root), np.int64)
        for at in np.split(order, changes):
            sides = [at[block[at] == side[at[0]]] for side in (i, j)]
            if all(map(len, sides)):
                mine = np.concatenate([np.arange(bounds[k], bounds[k + 1]) for k in at.tolist()])
                inside = np.concatenate(([0], np.cumsum(np.diff(bounds)[at])))
                number[at] = np.arange(len(at))
                found[at] += links_within(values[mine], inside, *[number[x] for x in sides], rules)
        return pa.table([table.column("set"), pa.array(found)], names=["set", "n"])

    counted = cells.groupBy("cell").applyInArrow(run, "set long, n long")
    return counted.groupBy("set").agg(F.sum("n").alias("n_links"))


def _source(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(docs[doc_id].alias("id"), docs[text].alias("text"), F.xxhash64(docs[text]).alias("text_key"))


def jaccard_links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, numerator: int = 9, denominator: int = 10) -> DataFrame:
    """(set_a, set_b, common, union): all links between different sets of ``docs``, once each with set_a < set_b."""
    rules = Rules(shingle, numerator, denominator)
    source = _source(docs, doc_id, text)
    return link_sets(source.drop("text_key"), materialize(set_table(source, rules)), rules)


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, numerator: int = 9, denominator: int = 10, count_links: bool = True) -> DataFrame:
    """One row per row of ``docs``: (id, text_key, n_shingles, set, group, component_id, n_links).

    ``text_key`` is the 64-bit hash of the text, ``set`` names the class of equal
    sets and ``group`` the component (both null for an empty set);
    ``component_id`` is the smallest id reachable by links and ``n_links`` the number of
    other sets that link with the row's set (copies of a text are one set), from all pairs
    of sets of a component. Without ``count_links`` only components are made, which need no
    link between sets that are already joined; ``jaccard_links`` gives the links themselves.
    """
    rules = Rules(shingle, numerator, denominator)
    source = _source(docs, doc_id, text)
    rows = materialize(set_table(source, rules))
    roots = joining_links(source.drop("text_key"), rows, rules)
    joined_sets = roots.withColumnRenamed("node", "set")
    if count_links:
        joined_sets = joined_sets.join(link_counts(source.drop("text_key"), rows, roots, rules), "set", "left")
    placed = rows.drop("asks", "counts", *_SKETCH_COLUMNS).join(joined_sets, "set", "left").withColumn("root", F.coalesce("root", "set"))
    smallest = placed.filter("root is not null").groupBy("root").agg(F.min("id").alias("component"))
    joined = placed.join(smallest, "root", "left")
    component = F.coalesce(F.when(F.col("root").isNotNull(), F.col("component")), "id").alias("component_id")
    counts = [F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] if count_links else []
    return joined.select("id", "text_key", "n_shingles", "set", F.col("root").alias("group"), component, *counts)
