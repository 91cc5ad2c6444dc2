"""Boosted trees by histograms over blocks of rows.

The trees are those of Spark's GBTClassifier: least squares on the gradient of the logistic loss
with labels of -1 and 1, the first tree on the labels themselves, and the result is its model.
Spark's trainer holds a number for each slot of each row and adds up each of them in each pass;
with one slot per category that is some hundred slots for a few columns. Here a column of
categories is one column of small integers, of which a row adds to one slot, numbers are bins,
and a few such columns are one column of cells, from whose sums theirs follow. A block of some
ten thousand rows is an array per group of columns. A level of a tree is a pass over the
blocks: each task sums counts, weights and gradients by node and bin, and the driver, from these
sums alone, cuts the nodes. The margins that the trees have reached go along with the blocks; every
few trees they are made anew from the first blocks, so that the chain of passes stays short.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

ACCURACY = 10_000
#: Rows of a partition of blocks at most, about.
PARTITION_ROWS = 4_000_000
BLOCK_ROWS = 1 << 16
#: Columns are put together while they have no more cells than that.
CELLS = 1 << 12
#: So many trees are added to the margins of a block in each pass before these are held anew.
HELD_TREES = 4
#: Margins are made anew from the first blocks after so many trees.
FRESH_TREES = 20
#: Bytes of the sums of one pass in a task; a level with more nodes takes more passes.
SUM_BYTES = 256 << 20
#: Bytes of all tasks' sums that are added up at the driver, in the tasks' order; more are added up by tasks first.
SENT_BYTES = 64 << 20


@dataclass
class Node:
    """Sums of the rows in a node, and its cut: rows of a bin above `bin`, or of the category `bin`, go right."""

    n: float
    weight: float
    total: float
    squares: float = math.nan  # not counted for a leaf at the greatest depth
    column: int = -1
    bin: int = -1
    gain: float = 0.0
    children: list[Node] = field(default_factory=list)


@dataclass(frozen=True)
class _Layout:
    """Cuts between the bins of each numeric column, numbers of categories of each other one, and where a column's bins start."""

    cuts: list[np.ndarray]
    sizes: list[int]
    positive: float

    @property
    def bins(self) -> list[int]:
        return [len(c) + 1 for c in self.cuts] + [n + 1 for n in self.sizes]  # the last one: no category

    @property
    def starts(self) -> np.ndarray:
        return np.append(0, np.cumsum(self.bins))

    @property
    def groups(self) -> list[range]:
        """Columns that are next to each other, put together."""
        out, cells = [range(0, 0)], 1
        for k, n in enumerate(self.bins):
            if cells * n > CELLS and len(out[-1]):
                out.append(range(k, k))
                cells = 1
            out[-1] = range(out[-1].start, k + 1)
            cells *= n
        return out

    @property
    def shapes(self) -> list[list[int]]:
        return [[self.bins[k] for k in g] for g in self.groups]

    @property
    def kinds(self) -> list[Any]:
        return [np.uint8 if n <= 1 << 8 else np.uint16 if n <= 1 << 16 else np.int32 for n in map(math.prod, self.shapes)]


def _between(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Halfway between neighbours; the lower one where no number is between."""
    with np.errstate(invalid="ignore", over="ignore"):
        middle = (low + high) / 2
    return np.where((middle >= low) & (middle < high), middle, low)


def _distinct(rows: DataFrame, columns: list[str], most: int) -> tuple[int, list[list[float] | None]]:
    """The number of rows, and each column's distinct values, ascending; None for more than `most`."""
    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray | None] = [np.empty(0) for _ in columns]
        n = 0
        for batch in batches:
            n += batch.num_rows
            for k, own in enumerate(held):
                if own is not None:
                    own = np.unique(np.append(own, batch.column(k).to_numpy(zero_copy_only=False)))
                    held[k] = own if len(own) <= most else None
        lists = [None if own is None else own.tolist() for own in held]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(lists)), pa.int32()), pa.array([n] + [0] * len(lists), pa.int64()),
                                          pa.array([[], *lists], pa.list_(pa.float64()))], names=["k", "n", "held"])

    parts = rows.select(*columns, F.lit(0).alias("_one")).mapInArrow(made, "k int, n bigint, held array<double>")  # a row per task and column
    found = {r["k"]: r for r in parts.groupBy("k").agg(F.sum("n").alias("n"), F.bool_or(F.col("held").isNull()).alias("many"),
                                                       F.array_sort(F.array_distinct(F.flatten(F.collect_list("held")))).alias("held")).collect()}
    lists = [found[k] for k in range(len(columns))] if found else []
    return (found[-1]["n"] if found else 0), [None if r["many"] or len(r["held"]) > most else r["held"] for r in lists]


def _cuts(rows: DataFrame, columns: list[str], most: int) -> tuple[int, list[np.ndarray]]:
    """The number of rows, and the cuts of each column into at most `most` bins: between all values if they are so few, else at quantiles."""
    n, held = _distinct(rows, columns, most)
    many = [k for k, values in enumerate(held) if values is None]
    marks = {}
    if many:
        shares = [i / most for i in range(1, most)]
        found = rows.agg(*[F.percentile_approx(columns[k], shares, ACCURACY).alias(f"m{k}") for k in many]).first()
        marks = {k: np.unique(found[f"m{k}"]) for k in many}
    cuts = []
    for k, values in enumerate(held):
        own = np.array(values or [])
        own = own[~np.isnan(own)]
        cuts.append(marks[k] if values is None else _between(own[:-1], own[1:]))
    return n, cuts


def _blocks(rows: DataFrame, label: str, columns: list[str], layout: _Layout) -> DataFrame:
    """(block, label, data): the labels and the cells of some rows that a task reads one after the other."""
    width, groups, shapes, kinds = len(layout.cuts), layout.groups, layout.shapes, layout.kinds

    def binned(k: int, values: pa.Array) -> np.ndarray:
        if k < width:
            return np.searchsorted(layout.cuts[k], values.to_numpy(zero_copy_only=False))
        return values.fill_null(layout.sizes[k - width]).to_numpy(zero_copy_only=False)

    def celled(batch: pa.RecordBatch) -> tuple[bytes, list[bytes]]:
        labels = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
        if not np.isin(labels, (0.0, 1.0)).all():
            raise ValueError("Boosted trees are fitted on labels of 0 and 1.")
        cells = [np.ravel_multi_index([binned(k, batch.column(k + 1)) for k in g], shape) for g, shape in zip(groups, shapes)]
        return labels.astype(np.int8).tobytes(), [c.astype(kind).tobytes() for c, kind in zip(cells, kinds)]

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, held, n = TaskContext.get().partitionId(), 0, [], 0

        def block() -> pa.RecordBatch:
            labels, data = zip(*held)
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | place], pa.int64()), pa.array([b"".join(labels)], pa.binary()),
                                               pa.array([[b"".join(d) for d in zip(*data)]], pa.list_(pa.binary()))], names=["block", "label", "data"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(celled(batch))
            n += batch.num_rows
            if n >= BLOCK_ROWS:
                yield block()
                place, held, n = place + 1, [], 0
        if held:
            yield block()

    return rows.select(label, *columns).mapInArrow(made, "block bigint, label binary, data array<binary>")


def _opened(kinds: list) -> Any:
    """A block's id, cells by group, labels of -1 and 1, and margins."""
    def of(row) -> tuple:
        y = np.frombuffer(row["label"], np.int8)
        return row["block"], [np.frombuffer(d, kind) for d, kind in zip(row["data"], kinds)], y * np.int8(2) - np.int8(1), np.zeros(len(y))

    return of


class _Sides:
    """The rows of a block on either side of a node's cut."""

    def __init__(self, layout: _Layout):
        self.width = len(layout.cuts)
        self.at = {k: (g, shape, k - group.start) for g, (group, shape) in enumerate(zip(layout.groups, layout.shapes)) for k in group}

    def of(self, node: Node, cells: list[np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        g, shape, axis = self.at[node.column]
        own = cells[g].take(rows)
        if len(shape) == 1:
            right = self._right(node, own)
        else:  # which cells are on the right
            ones = [1] * len(shape)
            ones[axis] = shape[axis]
            right = np.broadcast_to(self._right(node, np.arange(shape[axis])).reshape(ones), shape).ravel().take(own)
        return rows[~right], rows[right]

    def _right(self, node: Node, bins: np.ndarray) -> np.ndarray:
        return bins > node.bin if node.column < self.width else bins == node.bin

    def leaves(self, node: Node, cells: list[np.ndarray], rows: np.ndarray) -> Iterator[tuple[Node, np.ndarray]]:
        """The leaves of a tree with their rows, from left to right."""
        if not node.children:
            yield node, rows
            return
        for child, own in zip(node.children, self.of(node, cells, rows)):
            yield from self.leaves(child, cells, own)


def _advanced(trees: list[tuple[float, Node]], layout: _Layout) -> Any:
    """Blocks with margins that trees have been added to."""
    sides = _Sides(layout)

    def of(block: tuple) -> tuple:
        place, cells, y, margin = block
        margin, every = margin.copy(), np.arange(len(y), dtype=np.int32)
        for weight, root in trees:
            for leaf, rows in sides.leaves(root, cells, every):
                margin[rows] += weight * (leaf.total / leaf.weight)
        return place, cells, y, margin

    return of


def _summed(trees: list[tuple[float, Node]], root: Node | None, wanted: range, layout: _Layout, number: int, share: float, seed: int) -> Any:
    """The sums of a partition's blocks, to whose margins `trees` are added, for those leaves of a growing tree
    whose places are wanted: counts, weights and gradients by bin, and at the end of the first row the squares."""
    starts, groups, shapes = layout.starts, layout.groups, layout.shapes
    sides, advanced = _Sides(layout), _advanced(trees, layout)
    kinds = 2 if layout.positive == 1 else 3  # weights of one are the counts

    def of(blocks: Iterable[tuple]) -> Iterator[np.ndarray]:
        sums = [np.zeros((len(wanted), 3, math.prod(shape))) for shape in shapes]
        squares = np.zeros(len(wanted))
        for block in blocks:
            place, cells, y, margin = advanced(block) if trees else block
            rows = np.arange(len(y), dtype=np.int32)
            if share < 1:
                rows = rows[np.random.default_rng((seed & (1 << 63) - 1, number, place)).random(len(y)) < share]
            weight = np.where(y > 0, layout.positive, 1.0)
            # the gradient of the loss; the first tree is fitted on the labels
            with np.errstate(over="ignore"):
                pull = weight * (4.0 * y / (1 + np.exp(2.0 * y * margin)) if number else y)
            leaves = [rows] if root is None else [own for leaf, own in sides.leaves(root, cells, rows) if leaf.column == -1]
            for at, leaf in enumerate(wanted):
                own = leaves[leaf]
                pulls, weights = pull.take(own), weight.take(own)
                squares[at] += np.sum(pulls * pulls / weights)
                for cell, held in zip(cells, sums):
                    values, n = cell.take(own), held.shape[2]
                    held[at, 0] += np.bincount(values, minlength=n)
                    held[at, 1] += np.bincount(values, pulls, n)
                    if kinds == 3:
                        held[at, 2] += np.bincount(values, weights, n)
        out = np.zeros((len(wanted), 3, starts[-1] + 1))
        for group, shape, held in zip(groups, shapes, sums):
            by = held.reshape(len(wanted), 3, *shape)
            for axis, k in enumerate(group):
                own = by.sum(axis=tuple(2 + a for a in range(len(shape)) if a != axis))
                out[:, :, starts[k] : starts[k + 1]] = own[:, [0, 2 if kinds == 3 else 0, 1]]
        out[:, 0, -1] = squares
        yield out

    return of


def _added(parts: Any, cells: int, tasks: int) -> np.ndarray:
    if cells * 8 * tasks <= SENT_BYTES:
        return sum(parts.collect())  # a sum per task, in their order
    return parts.treeReduce(np.add)


def _cut(node: Node, sums: np.ndarray, layout: _Layout, allowed: np.ndarray, least: int, gain: float) -> bool:
    """Cuts a node where that leaves the least variance, if a cut is allowed and gains enough."""
    starts, width = layout.starts, len(layout.cuts)
    every = sums[:, :-1]
    places, rights = [], []
    for k, n in enumerate(layout.bins):
        own = every[:, starts[k] : starts[k + 1]]
        if k < width:
            right, free = (own.sum(axis=1, keepdims=True) - np.cumsum(own, axis=1))[:, : n - 1], np.repeat(allowed[k], n - 1)
        else:
            first = width + sum(layout.sizes[: k - width])
            right, free = own[:, : n - 1], allowed[first : first + n - 1]
        places.append(np.stack([np.full(n - 1, k), np.arange(n - 1)])[:, free])
        rights.append(right[:, free])
    place, (rn, rw, rs) = np.concatenate(places, axis=1), np.concatenate(rights, axis=1)
    ln, lw, ls = node.n - rn, node.weight - rw, node.total - rs
    fits = (rn >= least) & (ln >= least)
    if not fits.any():
        return False
    with np.errstate(divide="ignore", invalid="ignore"):
        gains = np.where(fits, (ls**2 / lw + rs**2 / rw - node.total**2 / node.weight) / node.weight, -np.inf)
    best = int(np.argmax(gains))
    if gains[best] <= 0 or gains[best] < gain:
        return False
    node.column, node.bin, node.gain = int(place[0, best]), int(place[1, best]), float(gains[best])
    node.children = [Node(float(ln[best]), float(lw[best]), float(ls[best])), Node(float(rn[best]), float(rw[best]), float(rs[best]))]
    return True


def _frontier(node: Node) -> Iterator[Node]:
    """Leaves that are not closed, from left to right."""
    if node.children:
        for child in node.children:
            yield from _frontier(child)
    elif node.column == -1:
        yield node


def _asked(strategy: str, slots: int) -> int:
    """How many slots a node may be cut at, as Spark's featureSubsetStrategy has it."""
    named = {"auto": slots, "all": slots, "sqrt": math.ceil(math.sqrt(slots)), "log2": max(1, math.ceil(math.log2(slots))), "onethird": math.ceil(slots / 3)}
    if strategy in named:
        return named[strategy]
    return min(slots, int(strategy)) if strategy.isdigit() else math.ceil(float(strategy) * slots)


def _tree(rows: Any, trees: list[tuple[float, Node]], number: int, layout: _Layout, params: GBTClassifier) -> Node:
    """One tree on the gradients at the margins of the blocks, to which `trees` are added: a pass for each level."""
    seed, share, slots = params.getSeed(), params.getSubsamplingRate(), len(layout.cuts) + sum(layout.sizes)
    asked = _asked(params.getFeatureSubsetStrategy(), slots)
    rng = np.random.default_rng((seed & (1 << 63) - 1, number))
    cells = 3 * (int(layout.starts[-1]) + 1)
    root: Node | None = None
    tasks = rows.getNumPartitions()
    depth = params.getMaxDepth()
    for _ in range(max(1, depth)):  # a tree of depth 0 is one leaf, whose sums are asked for too
        open_ = [None] if root is None else list(_frontier(root))
        fit = max(1, SUM_BYTES // (8 * cells))
        groups = [range(at, min(at + fit, len(open_))) for at in range(0, len(open_), fit)]
        sums = [one for g in groups for one in _added(rows.mapPartitions(_summed(trees, root, g, layout, number, share, seed)), cells * len(g), tasks)]
        for node, own in zip(open_, sums):
            if node is None:
                first = own[:, : layout.starts[1]].sum(axis=1)  # each row is in one bin of the first column
                if not first[0]:
                    raise ValueError("There are no rows to fit a tree on.")
                node = root = Node(*map(float, first))
            node.squares = float(own[0, -1])
            allowed = np.ones(slots, bool)
            if asked < slots:
                allowed[rng.permutation(slots)[asked:]] = False
            if not depth or not _cut(node, own, layout, allowed, params.getMinInstancesPerNode(), params.getMinInfoGain()):
                node.column = -2  # closed
        if not any(True for _ in _frontier(root)):
            break
    return root


def _spark_node(jvm: Any, node: Node, layout: _Layout) -> Any:
    """A node as Spark's trees have it."""
    doubles = jvm.java.lang.reflect.Array.newInstance(jvm.java.lang.Double.TYPE, 3)
    for k, v in enumerate((node.weight, node.total, node.squares)):
        doubles[k] = v
    mean = node.total / node.weight
    spread = max(node.squares / node.weight - mean * mean, 0.0) if not math.isnan(node.squares) else math.nan
    held = jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator(doubles, int(node.n))
    trees = jvm.org.apache.spark.ml.tree
    if not node.children:
        return trees.LeafNode(mean, spread, held)
    width = len(layout.cuts)
    if node.column < width:
        split = trees.ContinuousSplit(node.column, float(layout.cuts[node.column][node.bin]))
    else:
        split = trees.ContinuousSplit(width + sum(layout.sizes[: node.column - width]) + node.bin, 0.5)
    left, right = (_spark_node(jvm, c, layout) for c in node.children)
    return trees.InternalNode(mean, spread, node.gain, left, right, split, held)


def _spark_model(rows: DataFrame, trees: list[tuple[float, Node]], layout: _Layout, params: GBTClassifier) -> GBTClassificationModel:
    jvm, slots = rows.sparkSession.sparkContext._jvm, len(layout.cuts) + sum(layout.sizes)
    kind = jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel
    gateway = rows.sparkSession.sparkContext._gateway
    held, weights = gateway.new_array(kind, len(trees)), gateway.new_array(jvm.double, len(trees))
    for k, (weight, root) in enumerate(trees):
        held[k], weights[k] = kind(_spark_node(jvm, root, layout), slots), float(weight)
    made = jvm.org.apache.spark.ml.classification.GBTClassificationModel(params.uid, held, weights, slots, 2)
    return params._copyValues(GBTClassificationModel(made))


def fit_boosted_trees(rows: DataFrame, params: GBTClassifier, *, numeric: list[str], numbers: list[str], sizes: list[int], positive: float = 1.0) -> GBTClassificationModel:
    """Trees on slots of numeric columns (doubles) and of columns of category numbers below `sizes`, null for none.

    The model's features are the numeric columns and then a slot for each category. `positive`: the weight of a row with label 1.
    """
    params._transfer_params_to_java()  # checks them
    context = rows.sparkSession.sparkContext
    rows = rows.select(params.getLabelCol(), *numeric, *numbers)
    n, cuts = _cuts(rows, numeric, params.getMaxBins())
    layout = _Layout(cuts, sizes, positive)
    parts = max(context.defaultParallelism, -(-n // PARTITION_ROWS))
    blocks = _blocks(rows, params.getLabelCol(), [*numeric, *numbers], layout).repartition(parts).sortWithinPartitions("block")
    first = now = blocks.rdd.map(_opened(layout.kinds)).persist(StorageLevel.MEMORY_AND_DISK)
    trees: list[tuple[float, Node]] = []
    held, last = 0, first  # trees that the margins of `now` have; what it was made from
    try:
        for number in range(params.getMaxIter()):
            if number - held >= HELD_TREES:
                fresh = number % FRESH_TREES == 0
                last, now = now, (first if fresh else now).map(_advanced(trees if fresh else trees[held:], layout)).persist(StorageLevel.MEMORY_AND_DISK)
                held = number
            trees.append((params.getStepSize() if trees else 1.0, _tree(now, trees[held:], number, layout, params)))
            if last not in (first, now):
                last.unpersist()
                last = first
    finally:
        now.unpersist()
        first.unpersist()
    return _spark_model(rows, trees, layout, params)
