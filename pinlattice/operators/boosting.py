"""Newton histogram boosting as Spark aggregation jobs.

One job per tree level serves all heads. A task adds the gradients and Hessians of its rows to
dense histograms (feature x bin) of the nodes that have to be counted, batch by batch; the
histograms of a node meet in one group, and one row per node comes back. Of two sibling nodes only
the smaller one is counted, the other is their parent less that. What the driver holds depends on
heads, nodes, features and bins, never on rows.

The state is packed: a row is a block of a few thousand training rows, whose bins (feature by
feature) and logits (head by head) are byte strings that numpy reads as they are, so no value is
converted between Spark and numpy in the passes. Labels and weights of all heads are a number per row
that points to the block's distinct ones. Features are counted several at a time: those whose bins
together make few cells share one histogram of all their combinations, summed up for each in the end. Trees since the last written state are
applied inside the tasks; every ``checkpoint_every`` trees the state is written anew.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pinlattice.constants import LEAF_LIMIT, MINIMUM_GAIN
from pinlattice.functions.vectors import noisy_or
from pinlattice.session import materialize, spread, tasks_of_passes


# Cells of a histogram that features share: it stays in a core's cache.
_CELLS = 1 << 13


@dataclass(frozen=True)
class BoostingOptions:
    trees: int = 70
    learning_rate: float = 0.07
    depth: int = 3
    minimum_leaf: int = 30
    l2: float = 2.0
    feature_fraction: float = 0.65
    seed: int = 20260726
    checkpoint_every: int = 10


@dataclass
class Node:
    value: float
    feature: int = -1
    split_bin: int = -1
    left: int = -1
    right: int = -1


@dataclass
class BoostedHead:
    base_logit: float
    learning_rate: float
    trees: list[list[Node]] = field(default_factory=list)

    def payload(self) -> dict:
        return {
            "base_logit": self.base_logit,
            "learning_rate": self.learning_rate,
            "trees": [{"nodes": [vars(n) for n in tree]} for tree in self.trees],
        }

    @classmethod
    def from_payload(cls, payload: Mapping) -> BoostedHead:
        trees = [[Node(**n) for n in tree["nodes"]] for tree in payload["trees"]]
        return cls(float(payload["base_logit"]), float(payload["learning_rate"]), trees)


def _chosen_features(options: BoostingOptions, tree: int, node: int, width: int) -> list[int]:
    """Feature sample of one node; a pure function of (seed, tree, node)."""
    count = max(1, round(width * options.feature_fraction))
    rng = np.random.default_rng([options.seed, tree, node])
    return sorted(int(i) for i in rng.choice(width, count, replace=False))


@dataclass
class _Head:
    """What the driver knows of one head while it grows."""

    options: BoostingOptions
    model: BoostedHead
    # Histograms of the current tree's nodes: node -> array of (features, bins, 3).
    sums: dict[int, np.ndarray] = field(default_factory=dict)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(flat) else np.zeros((len(column), width))


_BLOCK = "bins binary, y binary, w binary, logits binary"


def _block(parts: Sequence[np.ndarray], names: Sequence[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], names=list(names))


def _packed_rows(rows: DataFrame, width: int, bins: int, base: list[float]) -> DataFrame:
    """Blocks of the rows (bins, y, w): a block is one batch, its arrays have features or heads in front."""
    kind = np.uint8 if bins <= 1 << 8 else np.int32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                matrix = _matrix(batch.column(0), width)
                if matrix.size and matrix.dtype.kind == "f":
                    raise ValueError("a bin is null")
                matrix = matrix.astype(kind).T
                y, w = (_matrix(batch.column(i), len(base)).T for i in (1, 2))
                yield _block([matrix, y, w, np.repeat(base, batch.num_rows)], ["bins", "y", "w", "logits"])

    return rows.mapInArrow(run, _BLOCK)


_STATE = "bins binary, kinds binary, kind binary, logits binary"


def _pointed(state: DataFrame, heads: int) -> DataFrame:
    """Packed rows with the distinct labels and weights of a block (``kinds``) and which of them a row has (``kind``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bins, y, w, logits in zip(*[batch.column(i) for i in range(4)], strict=True):
                both = [v for x in (y, w) for v in np.frombuffer(x.as_buffer()).reshape(heads, -1)]
                kind = np.zeros(len(both[0]), np.int64)
                for v in both:  # no more numbers than rows after each step
                    found = pa.array(v).dictionary_encode()
                    pair = kind * len(found.dictionary) + found.indices.to_numpy()
                    kind = pa.array(pair).dictionary_encode().indices.to_numpy().astype(np.int64)
                at = np.unique(kind, return_index=True)[1]
                kinds = np.stack([v[at] for v in both])
                yield _block([np.frombuffer(bins.as_buffer(), np.uint8), kinds, kind.astype(_code(len(at))), np.frombuffer(logits.as_buffer())], ["bins", "kinds", "kind", "logits"])

    return state.mapInArrow(run, _STATE)


def _code(kinds: int) -> type:
    return np.uint8 if kinds <= 1 << 8 else np.uint32


def _blocks(batches: Iterator[pa.RecordBatch], width: int, bins: int, heads: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(bins by feature, distinct labels and weights by head, which of them a row has, logits by head) of every block."""
    of = np.uint8 if bins <= 1 << 8 else np.int32
    for batch in batches:
        for matrix, kinds, kind, logits in zip(*[batch.column(i) for i in range(4)], strict=True):
            pairs = np.frombuffer(kinds.as_buffer()).reshape(2, heads, -1)
            at = np.frombuffer(kind.as_buffer(), _code(pairs.shape[2]))
            yield np.frombuffer(matrix.as_buffer(), of).reshape(width, len(at)), pairs, at, np.frombuffer(logits.as_buffer()).reshape(heads, -1)


def _places(nodes: list[Node], matrix: np.ndarray) -> np.ndarray:
    """The node every row ends in; ``matrix`` has a line per feature."""
    kind = np.int8 if len(nodes) < 1 << 7 else np.int16 if len(nodes) < 1 << 15 else np.int32

    def below(i: int) -> np.ndarray:
        node = nodes[i]
        if node.feature < 0:
            return kind(i)
        left, right = below(node.left), below(node.right)
        # A choice by bits: numpy works on it in vectors, which it does not with where().
        return right ^ ((left ^ right) & -(matrix[node.feature] <= node.split_bin).view(np.int8).astype(kind, copy=False))

    found = below(0)
    return found if found.ndim else np.full(matrix.shape[1], found)


def _advanced(logits: np.ndarray, matrix: np.ndarray, recent: list[list[list[Node]]], rates: list[float]) -> np.ndarray:
    """The logits with the recent trees of every head added."""
    logits = np.array(logits)
    for h, trees in enumerate(recent):
        for tree in trees:
            values = rates[h] * np.array([n.value for n in tree])
            logits[h] += values.take(_places(tree, matrix))
    return logits


def _shared(levels: Sequence[int]) -> list[list[int]]:
    """Features dealt to histograms; the bins of those that share one make at most ``_CELLS`` combinations, unless it is a single one."""
    groups: list[list[int]] = []
    cells: list[int] = []
    for f in sorted(range(len(levels)), key=lambda f: (-levels[f], f)):
        i = next((i for i, n in enumerate(cells) if n * levels[f] <= _CELLS), len(groups))
        if i == len(groups):
            groups.append([])
            cells.append(1)
        groups[i].append(f)
        cells[i] *= levels[f]
    return groups


def _histograms(
    state: DataFrame, levels: Sequence[int], recent: list[list[list[Node]]], rates: list[float], growing: list[list[Node]], wanted: list[list[int]]
) -> dict[tuple[int, int], np.ndarray]:
    """(head, node) -> sums of gradients, Hessians and rows by feature and bin, from one job."""
    width, bins = len(levels), max(levels, default=1)
    cells = width * bins
    groups = _shared(levels)
    sizes = [math.prod(levels[f] for f in group) for group in groups]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {(h, i): [np.zeros((3, n)) for n in sizes] for h, nodes in enumerate(wanted) for i in nodes}
        for matrix, (labels, weights), kind, logits in _blocks(batches, width, bins, len(rates)):
            logits = _advanced(logits, matrix, recent, rates)
            codes = []
            for group in groups:
                code = matrix[group[0]].astype(np.int16 if math.prod(levels[f] for f in group) <= _CELLS else np.int32)
                for f in group[1:]:
                    code *= levels[f]
                    code += matrix[f]
                codes.append(code)
            for h, nodes in enumerate(wanted):
                if not nodes:
                    continue
                place = _places(growing[h], matrix)
                counted = (weights[h] != 0).take(kind)
                for i in nodes:
                    rows = np.flatnonzero(counted & (place == i))
                    of = kind.take(rows)
                    weight = weights[h].take(of)
                    p = 1.0 / (1.0 + np.exp(-np.clip(logits[h].take(rows), -35.0, 35.0)))
                    g, k = weight * (labels[h].take(of) - p), weight * p * (1 - p)
                    for total, code, n in zip(sums[h, i], codes, sizes, strict=True):
                        where = code.take(rows)
                        total[0] += np.bincount(where, g, n)
                        total[1] += np.bincount(where, k, n)
                        total[2] += np.bincount(where, minlength=n)
        heads, nodes = zip(*sums, strict=True) if sums else ((), ())
        columns = [pa.array(heads, pa.int32()), pa.array(nodes, pa.int32()), pa.array([by_feature(x).tobytes() for x in sums.values()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["head", "node", "payload"])

    def by_feature(totals: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((3, width, bins))
        for group, total in zip(groups, totals, strict=True):
            joint = total.reshape(3, *[levels[f] for f in group])
            for axis, f in enumerate(group, 1):
                out[:, f, : levels[f]] = joint.sum(axis=tuple(a for a in range(1, joint.ndim) if a != axis))
        return out

    def unite(table: pa.Table) -> pa.Table:
        total = np.zeros(3 * cells)
        for payload in table.column("payload"):
            total += np.frombuffer(payload.as_buffer())
        return pa.table([table.column("head").slice(0, 1), table.column("node").slice(0, 1), pa.array([total.tobytes()], pa.binary())], names=["head", "node", "payload"])

    shape = "head int, node int, payload binary"
    # One row per open node: its cells, whatever the number of rows.
    found = state.mapInArrow(count, shape).groupBy("head", "node").applyInArrow(unite, shape).collect()
    return {(r["head"], r["node"]): np.frombuffer(bytes(r["payload"])).reshape(3, width, bins) for r in found}


def _best_split(sums: np.ndarray, features: list[int], options: BoostingOptions) -> tuple | None:
    """(feature, bin, left sums) of the largest gain; at ties the smallest feature, then bin."""
    left = np.cumsum(sums[:, features, :], axis=2)
    total = left[:, :, -1:]
    right = total - left
    l2 = options.l2
    gain = left[0] ** 2 / (left[1] + l2) + right[0] ** 2 / (right[1] + l2) - total[0] ** 2 / (total[1] + l2)
    valid = (left[2] >= options.minimum_leaf) & (right[2] >= options.minimum_leaf) & (gain > MINIMUM_GAIN)
    if not valid.any():
        return None
    f, b = divmod(int(np.argmax(np.where(valid, gain, -np.inf))), sums.shape[2])
    return features[f], b, left[:, f, b]


def _totals(sums: np.ndarray) -> np.ndarray:
    return sums[:, 0, :].sum(axis=1)


def _grow(state: DataFrame, levels: Sequence[int], tree: int, heads: list[_Head], recent: list[list[list[Node]]]) -> list[list[Node]]:
    """The next tree of every head, one job per level; nodes are numbered level by level."""
    rates = [h.options.learning_rate for h in heads]
    grown = [[Node(0.0)] for _ in heads]
    sizes: list[dict[int, float]] = [{} for _ in heads]
    # Nodes to split next, and for each the node to subtract from its parent where it is not counted.
    level = [[(0, None)] for _ in heads]
    for h in heads:
        h.sums = {}
    for depth in range(max(h.options.depth for h in heads)):
        wanted = [[i for i, sibling in nodes if sibling is None] if depth < h.options.depth else [] for h, nodes in zip(heads, level, strict=True)]
        if not any(wanted):
            break
        found = _histograms(state, levels, recent, rates, grown, wanted)
        following = [[] for _ in heads]
        for n, head in enumerate(heads):
            if depth >= head.options.depth:
                continue
            for i in wanted[n]:
                head.sums[i] = found[n, i]
            for i, difference in level[n]:
                if difference is not None:
                    parent, sibling = difference
                    head.sums[i] = head.sums[parent] - head.sums[sibling]
            for i, _ in level[n]:
                nodes, options = grown[n], head.options
                total = _totals(head.sums[i])
                if i == 0:
                    nodes[0].value = _leaf(total, options)
                if total[2] < 2 * options.minimum_leaf:
                    continue
                split = _best_split(head.sums[i], _chosen_features(options, tree, i, len(levels)), options)
                if split is None:
                    continue
                nodes[i].feature, nodes[i].split_bin, left = split
                pair = (len(nodes), len(nodes) + 1)
                nodes[i].left, nodes[i].right = pair
                for child, values in zip(pair, (left, total - left), strict=True):
                    sizes[n][child] = values[2]
                    nodes.append(Node(_leaf(values, options)))
                small, large = sorted(pair, key=lambda c: sizes[n][c])
                if sizes[n][large] >= 2 * options.minimum_leaf:
                    # The smaller one is counted even where it stays a leaf: the larger one needs it.
                    following[n] += [(small, None), (large, (i, small))]
        level = [sorted(x, key=lambda e: e[0]) for x in following]
    return grown


def _leaf(totals: Sequence[float], options: BoostingOptions) -> float:
    value = totals[0] / (totals[1] + options.l2)
    return float(min(max(value, -LEAF_LIMIT), LEAF_LIMIT))


def _fit_together(df: DataFrame, width: int, labels: Mapping[str, tuple[Column, Column]], options: Mapping[str, BoostingOptions]) -> dict[str, BoostedHead]:
    """All heads at once. ``labels`` maps a head to its 0/1 label and its weight (null or 0: no row of the head)."""
    names = list(labels)
    y = F.array(*[F.coalesce(label.cast("double"), F.lit(0.0)) for label, _ in labels.values()])
    w = F.array(*[F.coalesce(weight.cast("double"), F.lit(0.0)) for _, weight in labels.values()])
    rows = spread(df.select(F.col("bins").cast("array<int>").alias("bins"), y.alias("y"), w.alias("w")))
    sums = []
    for i in range(len(names)):
        yi, wi = F.get("y", F.lit(i)), F.get("w", F.lit(i))
        inside = wi > 0
        sums += [F.sum(F.when(inside, wi * yi)), F.sum(F.when(inside, wi)), F.min(F.when(inside, yi)), F.max(F.when(inside, yi))]
    found = rows.agg(*sums, *[F.max(F.get("bins", F.lit(f))) for f in range(width)], F.count(F.lit(1))).first()
    levels = [int(top or 0) + 1 for top in found[4 * len(names) : -1]]
    bins = max(levels, default=1)
    heads = []
    for i, name in enumerate(names):
        positive, total, low, high = found[4 * i : 4 * i + 4]
        if total is None or low == high:
            raise ValueError(f"head {name!r} needs both classes")
        rate = min(max(positive / total, 1e-6), 1 - 1e-6)
        heads.append(_Head(options[name], BoostedHead(float(np.log(rate / (1 - rate))), options[name].learning_rate)))
    rates = [h.options.learning_rate for h in heads]
    rows = rows.coalesce(tasks_of_passes(rows, found[-1]))
    state = materialize(_pointed(_packed_rows(rows, width, bins, [h.model.base_logit for h in heads]), len(heads)))
    recent: list[list[list[Node]]] = [[] for _ in heads]
    every = min(h.options.checkpoint_every for h in heads)

    trees = {h.options.trees for h in heads}
    if len(trees) > 1:
        raise ValueError("heads fitted together have the same number of trees")
    for number in range(*trees):
        for i, tree in enumerate(_grow(state, levels, number, heads, recent)):
            heads[i].model.trees.append(tree)
            recent[i].append(tree)
        if (number + 1) % every == 0 and number + 1 < heads[0].options.trees:
            state = materialize(state.mapInArrow(_renewed(width, bins, recent, rates), _STATE))
            recent = [[] for _ in heads]
    return {name: h.model for name, h in zip(names, heads, strict=True)}


def _renewed(width: int, bins: int, recent: list[list[list[Node]]], rates: list[float]):
    """A task function that adds the recent trees to the logits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for matrix, kinds, kind, logits in _blocks(batches, width, bins, len(rates)):
            yield _block([matrix, kinds, kind, _advanced(logits, matrix, recent, rates)], ["bins", "kinds", "kind", "logits"])

    return run


def fit_boosting(
    df: DataFrame,
    width: int,
    options: BoostingOptions = BoostingOptions(),
    label: str = "label",
    weight: str | None = None,
) -> BoostedHead:
    """Fit one head on rows with ``bins`` (array<int> of ``width``) and a 0/1 label; rows of weight 0 have no part."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    return _fit_together(df, width, {"only": (F.col(label), w)}, {"only": options})["only"]


def _probabilities(head: BoostedHead, matrix: np.ndarray) -> np.ndarray:
    """Probabilities of rows by their bins; ``matrix`` has a line per feature."""
    logit = np.full(matrix.shape[1], head.base_logit)
    for tree in head.trees:
        logit += (head.learning_rate * np.array([n.value for n in tree])).take(_places(tree, matrix))
    return 1.0 / (1.0 + np.exp(-np.clip(logit, -35.0, 35.0)))


def tree_probabilities(
    heads: Mapping[str, BoostedHead], features: Column, cuts: list[list[float]]
) -> Column:
    """struct with one probability per head, for an array of raw feature values.

    Binning and tree descent run on a whole Arrow batch at a time, and the bins
    are shared by all heads.
    """
    heads = dict(heads)
    edges = [np.asarray(c, dtype=float) for c in cuts]

    @F.arrow_udf(", ".join(f"`{name}` double" for name in heads))
    def score(batch: pa.Array) -> pa.Array:
        if batch.null_count:
            raise ValueError("the features of a row are null")
        values = _matrix(batch, len(edges))
        bins = np.stack([np.searchsorted(e, values[:, i], side="right") for i, e in enumerate(edges)])
        return pa.StructArray.from_arrays([pa.array(_probabilities(h, bins)) for h in heads.values()], names=list(heads))

    return score(features)


def head_population(head: str) -> tuple[Column, Column]:
    """(rows a head is trained on, its positive label)."""
    outcome = F.col("outcome")
    resolved = outcome != "resolution_failure"
    if head == "resolution":
        return F.lit(True), ~resolved
    if head == "post_install":
        return resolved, outcome != "pass"
    if head == "import":
        return resolved, outcome == "import_failure"
    if head == "smoke":
        return outcome.isin("pass", "smoke_test_failure"), outcome == "smoke_test_failure"
    raise ValueError(head)


TWO_HEAD = ("resolution", "post_install")
STAGE_AWARE = ("resolution", "import", "smoke")
SEED_OFFSETS = {"resolution": 0, "post_install": 10_000, "import": 10_000, "smoke": 20_000}


def fit_heads(
    df: DataFrame, width: int, heads: tuple[str, ...], options: BoostingOptions = BoostingOptions()
) -> dict[str, BoostedHead]:
    """Fit class-balanced heads on their nested populations (rows: bins, outcome), level by level together."""
    populations = {h: head_population(h) for h in heads}
    sums = []
    for inside, positive in populations.values():
        sums += [F.count_if(inside & positive), F.count_if(inside)]
    counts = df.agg(*sums).first()
    labels, seeded = {}, {}
    for i, (head, (inside, positive)) in enumerate(populations.items()):
        p, n = counts[2 * i], counts[2 * i + 1]
        if p == 0 or p == n:
            raise ValueError(f"head {head!r} needs both classes")
        balance = F.when(positive, n / (2.0 * p)).otherwise(n / (2.0 * (n - p)))
        labels[head] = positive.cast("int"), F.when(inside, balance)
        seeded[head] = BoostingOptions(**{**vars(options), "seed": options.seed + SEED_OFFSETS[head]})
    return _fit_together(df, width, labels, seeded)


def score_heads(
    df: DataFrame, heads: Mapping[str, BoostedHead], cuts: list[list[float]], features: str = "features"
) -> DataFrame:
    """Probability per head plus their noisy-or as ``probability``."""
    scored = df.withColumn("__p", tree_probabilities(heads, F.col(features), cuts))
    return scored.select(
        *df.columns,
        *[F.col(f"__p.{n}").alias(f"{n}_probability") for n in heads],
        noisy_or(*[F.col(f"__p.{n}") for n in heads]).alias("probability"),
    )
