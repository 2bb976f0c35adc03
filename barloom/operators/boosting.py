"""Gradient-boosted trees by histograms, many fits at a time.

All settings and folds grow together. Features are cut into quantile bins once and rows are packed
into blocks of bin numbers. For each level of a tree one job sums gradients by (fit, node, feature,
bin): a task sums its own blocks and sends one histogram a node, whatever number of rows it has, and the best split of
a node is chosen where its histograms meet. Leaf weights carry L1 and L2 penalties. Gradients are summed as
whole numbers, so a model does not depend on how rows are spread over tasks.

The driver holds the trees only: fits x trees x at most 2^(depth + 1) nodes.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.session import cut_lineage

BINS = 32
#: Rows of one block.
BLOCK = 2_048
#: A block's rows are held out of every fit of a group with this membership; -1 is neither.
TEST = 100
#: Nodes whose histograms one task adds up.
NODES = 64
#: Gradients are rounded to this many bits after the point.
FIXED = float(1 << 30)
#: (Row, fit) pairs of a task: at least so many, as a Python task has a cost of its own, and at most so many, for its memory.
TASK_PAIRS, MOST_PAIRS = 400_000, 20_000_000
#: Trees between two written states; in between a state is kept on the executors with its lineage.
WRITE_EVERY = 25


@dataclass(frozen=True)
class Fit:
    """One model: its settings, the membership column it reads and the fold it leaves out (-1: none)."""

    trees: int = 100
    depth: int = 3
    rate: float = 0.1
    rows: float = 1.0
    columns: float = 1.0
    min_child: float = 5.0
    l1: float = 0.0
    l2: float = 1.0
    group: int = 0
    left_out: int = -1
    setting: int = 0


@dataclass
class Tree:
    """Complete binary tree: children of node i are 2i + 1 (bin at most ``cut``) and 2i + 2; feature -1 is a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = (1 << (depth + 1)) - 1
        return cls(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n), np.zeros(n))

    def leaves(self, bins: np.ndarray, levels: int | None = None) -> np.ndarray:
        """The node that each row reaches, after so many levels if they are given."""
        node = np.zeros(len(bins), np.int64)
        at = np.arange(len(bins))
        for _ in range(int(np.log2(len(self.feature) + 1)) - 1 if levels is None else levels):
            f = self.feature[node]
            right = bins[at, np.maximum(f, 0)] > self.cut[node]
            node = np.where(f >= 0, 2 * node + 1 + right, node)
        return node


@dataclass
class Model:
    """Grown fits and the rows they were grown on, with each row's sum of leaf weights under every fit."""

    state: DataFrame
    fits: list[Fit]
    names: list[str]
    base: np.ndarray
    trees: list[list[Tree]] = field(default_factory=list)

    def scores(self, which: Sequence[int] | None = None) -> DataFrame:
        """fit, row_id, p_win of the rows each fit held out."""
        chosen = list(range(len(self.fits))) if which is None else list(which)
        return self._by_row(chosen, lambda fit, member, bins, margin: ((member == (TEST if fit.left_out < 0 else fit.left_out)), 1 / (1 + np.exp(-margin))))

    def train_scores(self, which: Sequence[int]) -> DataFrame:
        return self._by_row(which, lambda fit, member, bins, margin: (_trains(fit, member), 1 / (1 + np.exp(-margin))))

    def _by_row(self, which, of) -> DataFrame:
        fits = self.fits

        def run(batches):
            for b in _blocks(batches, len(fits)):
                for k in which:
                    keep, value = of(fits[k], b.member[:, fits[k].group], b.bins, b.margin[:, k])
                    at = np.flatnonzero(keep)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), b.ids.take(pa.array(at)), pa.array(value[at])], names=["fit", "row_id", "p_win"])

        return self.state.mapInArrow(run, "fit int, row_id string, p_win double")

    def leaves(self, fit: int, held_out: bool) -> DataFrame:
        """row_id, tree, leaf of the rows that a fit was grown on, or of those it held out."""
        trees, f, n = self.trees[fit], self.fits[fit], len(self.fits)

        def run(batches):
            for b in _blocks(batches, n):
                member = b.member[:, f.group]
                at = np.flatnonzero((member == (TEST if f.left_out < 0 else f.left_out)) if held_out else _trains(f, member))
                ids, bins = b.ids.take(pa.array(at)), b.bins[at]
                for i, tree in enumerate(trees):
                    yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(at), i, np.int32)), pa.array(tree.leaves(bins).astype(np.float64))], names=["row_id", "tree", "leaf"])

        return self.state.mapInArrow(run, "row_id string, tree int, leaf double")

    def importances(self, fit: int) -> list[tuple[str, float]]:
        """Share of each feature in the gains of a fit's splits, by mean gain of a split."""
        total, used = np.zeros(len(self.names)), np.zeros(len(self.names))
        for tree in self.trees[fit]:
            split = tree.feature >= 0
            np.add.at(total, tree.feature[split], tree.gain[split])
            np.add.at(used, tree.feature[split], 1)
        mean = total / np.maximum(used, 1)
        return sorted(zip(self.names, (mean / max(mean.sum(), 1e-300)).tolist(), strict=True), key=lambda kv: (-kv[1], kv[0]))


@dataclass
class Block:
    ids: pa.Array
    key: np.ndarray
    label: np.ndarray
    member: np.ndarray
    bins: np.ndarray
    margin: np.ndarray


_STATE = "ids array<string>, key binary, label binary, member binary, bins binary, margin binary"


def _blocks(batches, fits: int):
    for batch in batches:
        cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        for i in range(batch.num_rows):
            raw = {n: cols[n][i].as_buffer() for n in ("key", "label", "member", "bins", "margin")}
            label = np.frombuffer(raw["label"], np.int8)
            n = len(label)
            yield Block(cols["ids"][i].values, np.frombuffer(raw["key"], np.uint64), label,
                        np.frombuffer(raw["member"], np.int8).reshape(n, -1), np.frombuffer(raw["bins"], np.uint8).reshape(n, -1),
                        np.frombuffer(raw["margin"], np.float64).reshape(n, fits))


def _trains(fit: Fit, member: np.ndarray) -> np.ndarray:
    return (member >= 0) & (member != TEST) & (member != fit.left_out)


def quantile_edges(rows: DataFrame, columns: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """Per column the distinct values that end its bins; ``bins`` - 1 numbers at most."""
    shares = [i / bins for i in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(F.col(c).cast("double"), shares, 10_000).alias(f"_{i}") for i, c in enumerate(columns)]).first()
    return [np.unique(np.asarray(found[f"_{i}"] or [], np.float64)) for i in range(len(columns))]


def pack_rows(rows: DataFrame, columns: Sequence[str], members: Sequence[str], edges: list[np.ndarray], base: np.ndarray,
              label: str, row_id: str, parts: int) -> DataFrame:
    """Rows as blocks of bin numbers, labels and memberships, every fit's margin at its base."""
    plain = rows.select(F.col(row_id).cast("string").alias("id"), F.xxhash64(F.col(row_id).cast("string")).alias("key"), F.col(label).cast("int").alias("label"),
                        *(F.coalesce(F.col(m).cast("int"), F.lit(-1)).alias(f"m{i}") for i, m in enumerate(members)),
                        *(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)))
    first, n_members = 3, len(members)

    def run(batches):
        held: list[pa.RecordBatch] = []

        def block(table: pa.Table):
            number = lambda i: table.column(i).to_numpy()
            bins = np.stack([np.searchsorted(e, number(first + n_members + i), "left") for i, e in enumerate(edges)], axis=1).astype(np.uint8)
            member = np.stack([number(first + i) for i in range(n_members)], axis=1).astype(np.int8)
            body = [number(1).astype(np.int64).tobytes(), number(2).astype(np.int8).tobytes(), member.tobytes(), bins.tobytes(), np.tile(base, (table.num_rows, 1)).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([table.column(0).to_pylist()], pa.list_(pa.string())), *(pa.array([x], pa.binary()) for x in body)],
                                              names=["ids", "key", "label", "member", "bins", "margin"])

        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= BLOCK:
                table = pa.Table.from_batches(held)
                yield block(table.slice(0, BLOCK))
                held = table.slice(BLOCK).to_batches()
        if sum(b.num_rows for b in held):
            yield block(pa.Table.from_batches(held))

    return cut_lineage(plain.repartition(parts, "key").mapInArrow(run, _STATE)).coalesce(parts)


def _sampled(key: np.ndarray, fit: Fit, tree: int) -> np.ndarray:
    """The rows that a tree of a setting is grown on: a repeatable share of them."""
    if fit.rows >= 1:
        return np.ones(len(key), bool)
    x = key + np.uint64((0x9E3779B97F4A7C15 * (1 + tree * 1009 + fit.setting)) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) < np.uint64(int(fit.rows * float(1 << 63)) * 2)


def allowed_columns(fit: Fit, tree: int, n: int) -> np.ndarray:
    """The features that a tree of a setting may split on."""
    k = max(1, int(round(fit.columns * n)))
    return np.sort(np.random.default_rng([fit.setting, tree, 42]).permutation(n)[:k])


def weight(g, h, fit: Fit):
    return -np.sign(g) * np.maximum(np.abs(g) - fit.l1, 0) / (h + fit.l2)


def worth(g, h, fit: Fit):
    return np.maximum(np.abs(g) - fit.l1, 0) ** 2 / (h + fit.l2)


def best_split(hist: np.ndarray, fit: Fit, columns: np.ndarray):
    """feature, bin, gain, weight of the left and right child, own weight; feature -1 if no split gains.

    ``hist`` holds the sums of gradients and second derivatives by (feature, bin). Ties go to the first feature and bin.
    """
    g, h = np.cumsum(hist[..., 0], axis=1), np.cumsum(hist[..., 1], axis=1)
    all_g, all_h = float(g[0, -1]), float(h[0, -1])
    left_g, left_h = g[columns, :-1], h[columns, :-1]
    right_g, right_h = all_g - left_g, all_h - left_h
    with np.errstate(invalid="ignore", divide="ignore"):
        gain = worth(left_g, left_h, fit) + worth(right_g, right_h, fit) - worth(all_g, all_h, fit)
    gain = np.where((left_h >= fit.min_child) & (right_h >= fit.min_child) & (gain > 1e-9), gain, -np.inf)
    at = np.unravel_index(np.argmax(gain), gain.shape)
    own = float(weight(all_g, all_h, fit)) if all_h + fit.l2 > 0 else 0.0
    if not np.isfinite(gain[at]):
        return -1, 0, 0.0, 0.0, 0.0, own
    return (int(columns[at[0]]), int(at[1]), float(gain[at]), float(weight(left_g[at], left_h[at], fit)),
            float(weight(right_g[at], right_h[at], fit)), own)


@dataclass
class Rows:
    """What a level needs of a block."""

    key: np.ndarray
    label: np.ndarray
    member: np.ndarray
    bins: np.ndarray
    margin: np.ndarray


def _loaded(state: DataFrame, fits: int) -> RDD:
    """The blocks of a written state, kept as arrays: a level then is one job without a plan of its own."""
    def run(rows):
        for r in rows:
            label = np.frombuffer(r["label"], np.int8)
            n = len(label)
            yield Rows(np.frombuffer(r["key"], np.uint64), label, np.frombuffer(r["member"], np.int8).reshape(n, -1),
                       np.frombuffer(r["bins"], np.uint8).reshape(n, -1), np.frombuffer(r["margin"], np.float64).reshape(n, fits))

    return state.select("key", "label", "member", "bins", "margin").rdd.mapPartitions(run).persist(StorageLevel.MEMORY_AND_DISK)


def _level_splits(blocks: RDD, fits: list[Fit], grown: dict[int, Tree], tree: int, level: int, n_columns: int, bins: int) -> list:
    """fit, node and ``best_split`` of every node at ``level`` of the trees being grown: one job."""
    # The first column is always summed, as it tells a node's totals.
    summed = {fits[k].setting: np.union1d([0], allowed_columns(fits[k], tree, n_columns)) for k in grown}

    def histograms(part):
        sums: dict[int, np.ndarray] = {}
        for b in part:
            sampled: dict[int, np.ndarray] = {}
            for k, growing in grown.items():
                fit = fits[k]
                columns = summed[fit.setting]
                if fit.setting not in sampled:
                    sampled[fit.setting] = _sampled(b.key, fit, tree)
                rows = np.flatnonzero(_trains(fit, b.member[:, fit.group]) & sampled[fit.setting])
                own = b.bins[rows]
                node = growing.leaves(own, level) - ((1 << level) - 1)
                if level and (node < 0).any():
                    open_ = np.flatnonzero(node >= 0)
                    rows, node, own = rows[open_], node[open_], own[open_]
                if not len(rows):
                    continue
                span = len(columns) * bins
                p = 1 / (1 + np.exp(-b.margin[rows, k]))
                at = ((node * span)[:, None] + (np.arange(len(columns)) * bins + own[:, columns])).ravel()
                if k not in sums:
                    sums[k] = np.zeros(((1 << level) * span, 2), np.int64)
                for i, w in enumerate((p - b.label[rows], p * (1 - p))):
                    # Whole numbers below 2^53: exact in doubles.
                    sums[k][:, i] += np.bincount(at, np.repeat(np.rint(w * FIXED), len(columns)), (1 << level) * span).astype(np.int64)
        for k, body in sums.items():
            for j, s in enumerate(body.reshape(1 << level, -1, 2)):
                if s[:, 1].any():
                    yield (k, j), s

    def choose(part):
        # A task adds up the histograms of its own nodes as they come in.
        sums: dict[tuple[int, int], np.ndarray] = {}
        for at, hist in part:
            sums[at] = sums[at] + hist if at in sums else hist
        for (k, j), body in sums.items():
            whole = np.zeros((n_columns, bins, 2))
            whole[summed[fits[k].setting]] = body.reshape(-1, bins, 2) / FIXED
            yield k, j, *best_split(whole, fits[k], allowed_columns(fits[k], tree, n_columns))

    if blocks.getNumPartitions() == 1:
        return blocks.mapPartitions(lambda part: choose(histograms(part))).collect()
    tasks = -(-(len(grown) << level) // NODES)
    return blocks.mapPartitions(histograms).partitionBy(tasks, lambda at: (at[0] << level) + at[1]).mapPartitions(choose).collect()


def _moved(blocks: RDD, fits: list[Fit], grown: dict[int, Tree]) -> RDD:
    """The blocks after one more tree of each fit."""
    def run(b: Rows) -> Rows:
        margin = b.margin.copy()
        for k, tree in grown.items():
            margin[:, k] += fits[k].rate * tree.value[tree.leaves(b.bins)]
        return Rows(b.key, b.label, b.member, b.bins, margin)

    return blocks.map(run).persist(StorageLevel.MEMORY_AND_DISK)


def _advanced(state: DataFrame, fits: list[Fit], trees: list[dict[int, Tree]]) -> DataFrame:
    """A written state after some more trees of each fit, added in their order."""
    total = len(fits)

    def run(batches):
        for batch in batches:
            margins = []
            for b in _blocks([batch], total):
                margin = b.margin.copy()
                for grown in trees:
                    for k, tree in grown.items():
                        margin[:, k] += fits[k].rate * tree.value[tree.leaves(b.bins)]
                margins.append(margin.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(margins, pa.binary())], names=batch.schema.names)

    return state.mapInArrow(run, _STATE)


def grow(rows: DataFrame, columns: Sequence[str], fits: list[Fit], members: Sequence[str], label: str = "label",
         row_id: str = "trade_id", bins: int = BINS) -> Model:
    """Grow all ``fits`` together on ``rows``.

    ``members`` are integer columns: a fit reads the one of its ``group``, where -1 (or null) takes a row out, ``TEST``
    holds it out and any other value is its fold. Inputs must be present and finite, labels 0 or 1, row ids unique.
    A fit without rows, or with one class, predicts its base rate (0.5 without rows).
    """
    spark = rows.sparkSession
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    # Many small jobs of a known size: planning them anew at run time would take as long as they do.
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return _grown(rows, columns, fits, members, label, row_id, bins)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def _grown(rows: DataFrame, columns: Sequence[str], fits: list[Fit], members: Sequence[str], label: str, row_id: str, bins: int) -> Model:
    edges = quantile_edges(rows, columns, bins)
    counted = rows.agg(F.count(F.lit(1)).alias("rows"), *[F.sum(F.when(_trains_sql(f, members), x)).alias(f"_{i}_{j}")
                         for i, f in enumerate(fits) for j, x in enumerate((F.lit(1), F.col(label).cast("long")))]).first()
    n = np.array([counted[f"_{i}_0"] or 0 for i in range(len(fits))], float)
    won = np.array([counted[f"_{i}_1"] or 0 for i in range(len(fits))], float)
    share = np.clip(np.where(n > 0, won / np.maximum(n, 1), 0.5), 1e-6, 1 - 1e-6)
    base = np.log(share / (1 - share))
    pairs = max(1, counted["rows"] * len(fits))
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(-(-pairs // MOST_PAIRS), min(-(-pairs // TASK_PAIRS), usual))
    state = pack_rows(rows, columns, members, edges, base, label, row_id, parts)
    model = Model(state, fits, list(columns), base, [[] for _ in fits])
    blocks, since = _loaded(state, len(fits)), []
    kept = [blocks]
    rounds = max(f.trees for f in fits)
    for t in range(rounds):
        grown = {k: Tree.empty(f.depth) for k, f in enumerate(fits) if t < f.trees}
        open_ = dict(grown)
        for level in range(max(f.depth for f in fits)):
            open_ = {k: tree for k, tree in open_.items() if level < fits[k].depth}
            if not open_:
                break
            further = {}
            for k, j, feature, cut, gain, left, right, own in _level_splits(blocks, fits, open_, t, level, len(columns), bins):
                tree, i = open_[k], (1 << level) - 1 + j
                if level == 0:
                    tree.value[i] = own
                if feature >= 0:
                    tree.feature[i], tree.cut[i], tree.gain[i] = feature, cut, gain
                    tree.value[2 * i + 1], tree.value[2 * i + 2] = left, right
                    further[k] = tree
            open_ = further
        for k, tree in grown.items():
            model.trees[k].append(tree)
        since.append(grown)
        if (t + 1) % WRITE_EVERY and t + 1 < rounds:
            blocks = _moved(blocks, fits, grown)
        else:
            state, since = cut_lineage(_advanced(state, fits, since)).coalesce(parts), []
            for old in kept:
                old.unpersist()
            kept = []
            if t + 1 < rounds:
                blocks = _loaded(state, len(fits))
        kept.append(blocks)
        # All but the last two have been read for the last time; a lost one is made again from the written state.
        while len(kept) > 2:
            kept.pop(0).unpersist()
    model.state = state
    return model


def _trains_sql(fit: Fit, members: Sequence[str]):
    m = F.coalesce(F.col(members[fit.group]).cast("int"), F.lit(-1))
    return (m >= 0) & (m != TEST) & (m != fit.left_out)
