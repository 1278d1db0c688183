"""Histogram trees (L2, L3): second-order boosting and forests, many fits in one pass over the rows.

Rows are binned once (quantile cuts, at most ``MAX_BINS`` bins a feature) and kept as
blocks of at most ``CUT`` rows (a table of at most ``WHOLE`` times ``BLOCK`` rows as one block). A fit asks for one thing at a time: the sums of gradient,
hessian and rows by (node, feature, bin) for the nodes of a tree that may still be split.
All fits of a call (draws of a search x folds) ask together and one pass over the blocks
answers all of them; sums are added over blocks by (fit, tree) in a shuffle and only the
chosen splits reach the driver. Folds are masks on the same blocks: a fit that leaves a
fold out gives the fold's rows no weight, and scores them as it goes.

Gradients are rounded to a power of two below a 2^40th of the total weight, so that sums
are exact and the trees don't depend on how rows are dealt into blocks. If the whole table
is one block, there is nothing to exchange: each task then runs whole fits on that block by
the same code, instead of a job for every level. There, a tree's rows go one step a level, are
known when it is finished, and of two children only the one of fewer rows is counted (``Growing``).

Growth (``Spec.growth``):

* ``depth``: every node that gains is split, level by level.
* ``leaf``: the open leaf with the highest gain is split next, up to ``num_leaves``. Gains
  don't depend on the order, so levels are evaluated together: children are evaluated only
  for nodes among the first ``num_leaves - 1`` taken from the queue of gains, until those
  are known to be the ones that a one-by-one growth takes.
* ``oblivious``: one split for all nodes of a level, the one with the highest sum of gains.
* ``forest``: trees on rows drawn with Poisson(1) weights, grown until pure (Gini) unless a
  depth is given, a random choice of features at each node.

Gains are G_L^2/(H_L + lambda) + G_R^2/(H_R + lambda) - G^2/(H + lambda), with G shrunk by
``reg_alpha``; leaves take a Newton step. Rows are drawn by hashing their id with seed and
tree, so that a draw is the same on any cluster. Equal gains go to the first feature, then
the lowest cut.
"""

from __future__ import annotations

import heapq
import io
import math
import uuid
from collections.abc import Generator, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.session import checkpoint_dir

BLOCK = 5 << 16  # rows
WHOLE = 3  # blocks' rows that a task fits by itself: a job for every level costs more than counting them
HELD = 1 << 26  # bytes of the binned rows that a task fits by itself
CUT = 1 << 16  # rows of a block of a larger table
MAX_BINS = 255
CHECKPOINT = 25  # passes that change the rows' scores between two checkpoints
TOGETHER = 4  # trees of a forest that grow at once
ALONE = 16  # trees that all fits of a call grow at once, if these are more for each
MAX_MODEL = 1 << 29  # bytes of a model that is sent to the tasks
KEPT = 1 << 25  # bytes of a tree's sums that are kept until its next level
SMALL = 1 << 24  # bytes of all blocks' sums that the driver adds up; a 256th of it, of questions, goes without a broadcast
_U = np.uint64
TRAIN, VALIDATE, OTHER = 0, 1, 2


@dataclass(frozen=True)
class Spec:
    """Settings of one fit."""

    growth: str = "depth"
    n_trees: int = 100
    learning_rate: float = 0.1
    max_depth: int | None = 6
    num_leaves: int | None = None
    min_rows: int = 1  # of a child
    min_split: int = 2  # rows of a node that is split
    min_weight: float = 0.0  # hessian of a child
    reg_lambda: float = 0.0
    reg_alpha: float = 0.0
    min_gain: float = 0.0
    subsample: float = 1.0  # share of the rows, drawn anew every ``subsample_every`` trees
    subsample_every: int = 1
    colsample: float = 1.0  # share of the features of a tree
    node_features: str | float | None = None  # features of a node: "sqrt", "log2" or a share
    pos_weight: str = "ratio"  # weights of positives: "ratio" neg/pos, "balanced" n/2n_c of both classes, "none"
    start: str = "zero"  # score before the first tree: "zero" or "average" (log odds)
    patience: int | None = None  # trees without a better validation loss
    seed: int = 42
    held_out: int | None = None  # fold left out

    @property
    def forest(self) -> bool:
        return self.growth == "forest"


class Tree:
    """Nodes as arrays: children stand next to each other, ``left`` is -1 at a leaf."""

    def __init__(self):
        self.feature = np.zeros(1, np.int32)
        self.bin = np.zeros(1, np.int32)
        self.left = np.full(1, -1, np.int32)
        self.sums = np.zeros((1, 3))  # gradient, hessian (or weight), rows
        self.origin: np.ndarray | None = None  # of a pruned tree: its leaf for every node of the whole one

    def split(self, nodes: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Give ``nodes`` two children each; ids of the children, in pairs."""
        n = len(self.left)
        children = n + np.arange(2 * len(nodes))
        self.sums[nodes] = total
        self.feature[nodes], self.bin[nodes], self.left[nodes] = feature, cut, children[::2]
        pad = np.zeros(2 * len(nodes), np.int32)
        self.feature, self.bin, self.left = np.concatenate([self.feature, pad]), np.concatenate([self.bin, pad]), np.concatenate([self.left, pad - 1])
        self.sums = np.concatenate([self.sums, np.stack([left, total - left], 1).reshape(-1, 3)])
        return children

    def route(self, columns: np.ndarray, at: np.ndarray | None = None, steps: int | None = None) -> np.ndarray:
        """Leaf of every row (``columns``: features x rows), going on from ``at``, at most ``steps`` further down."""
        n = columns.shape[1]
        node = np.zeros(n, np.int64) if at is None else at
        inner = self.left >= 0
        base = np.where(inner, self.left, np.arange(len(inner)))  # a leaf's rows stay: no bin is above the last
        cut = np.where(inner, self.bin, MAX_BINS).astype(np.uint8)
        first = self.feature.astype(np.int64) * n
        flat, place = columns.ravel(), np.arange(n)
        while steps is None or steps > 0:
            rows = place
            if steps is None:
                moving = inner.take(node)
                some = np.count_nonzero(moving)
                if not some:
                    break
                if 2 * some <= n:
                    rows = np.flatnonzero(moving)
            else:
                steps -= 1
            here = node if len(rows) == n else node.take(rows)
            at = first.take(here)
            at += rows
            right = flat.take(at) > cut.take(here)
            here = base.take(here)
            here += right
            if len(rows) == n:
                node = here
            else:
                node[rows] = here
        return node

    def pruned(self, keep: set[int]) -> "Tree":
        """The tree with only the splits of ``keep``, whose parents are in it too."""
        out, queue = Tree(), [(0, 0)]
        out.sums = self.sums[:1].copy()
        out.origin = np.full(len(self.left), -1, np.int64)
        while queue:
            old, new = queue.pop(0)
            out.origin[old] = new
            if old in keep:
                l = self.left[old]
                pair = out.split(np.array([new]), self.feature[[old]], self.bin[[old]], self.sums[[l]], self.sums[[old]])
                queue += [(l, pair[0]), (l + 1, pair[1])]
        for old in np.flatnonzero(self.left >= 0).tolist():  # parents come first
            pair = slice(self.left[old], self.left[old] + 2)
            out.origin[pair] = np.where(out.origin[pair] < 0, out.origin[old], out.origin[pair])
        return out

    def values(self, spec: Spec) -> np.ndarray:
        """What a leaf adds to the score."""
        g, h = self.sums[:, 0], self.sums[:, 1]
        if spec.forest:
            return np.divide(g, h, out=np.zeros_like(g), where=h > 0)
        low = h + spec.reg_lambda
        return np.divide(-spec.learning_rate * _shrunk(g, spec.reg_alpha), low, out=np.zeros_like(g), where=low > 0)


def _shrunk(g: np.ndarray, alpha: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0) if alpha else g


def _score(g: np.ndarray, h: np.ndarray, spec: Spec) -> np.ndarray:
    low = h + spec.reg_lambda
    if spec.reg_lambda > 0:
        return _shrunk(g, spec.reg_alpha) ** 2 / low
    return np.divide(_shrunk(g, spec.reg_alpha) ** 2, low, out=np.zeros_like(g), where=low > 0)


def _mixed(key: np.ndarray, *salt: int) -> np.ndarray:
    """Uniform 64-bit hash of row keys and whole numbers."""
    h = np.array(key, _U)
    with np.errstate(over="ignore"):
        for s in salt:
            h ^= _U(s & (2**64 - 1))
            h *= _U(0x9E3779B97F4A7C15)
            h ^= h >> _U(30)
            h *= _U(0xBF58476D1CE4E5B9)
            h ^= h >> _U(27)
            h *= _U(0x94D049BB133111EB)
            h ^= h >> _U(31)
    return h


def _uniform(key: np.ndarray, *salt: int) -> np.ndarray:
    return (_mixed(key, *salt) >> _U(11)) * 2.0**-53


_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])  # P(X <= k) of Poisson(1)


# ------------------------------------------------------------------------- what a fit asks for
@dataclass
class Ask:
    """One question of a fit: add a finished tree to the scores, and the best splits of some nodes."""

    number: int  # of the tree that grows
    tree: Tree | None = None
    nodes: np.ndarray | None = None
    commit: Tree | None = None


@dataclass
class Splits:
    """Best split of each asked node (feature -1: none), the sums left of it and of the whole node."""

    gain: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    total: np.ndarray


def best_splits(keys: np.ndarray, sums: np.ndarray, n_nodes: int, layout: "Layout", spec: Spec, number: int, nodes: np.ndarray) -> Splits:
    """Best split of every node from sums by key (node x width + place of the feature's bin), keys rising."""
    out = Splits(np.full(n_nodes, -np.inf), np.full(n_nodes, -1, np.int64), np.zeros(n_nodes, np.int64), np.zeros((n_nodes, 3)), np.zeros((n_nodes, 3)))
    if not len(keys):
        return out
    row_node, place = np.divmod(keys, layout.width)
    feature = layout.feature[place]
    first = np.concatenate([[True], (feature[1:] != feature[:-1]) | (row_node[1:] != row_node[:-1])])
    starts = np.flatnonzero(first)
    size = np.diff(np.concatenate([starts, [len(keys)]]))
    left = np.cumsum(sums.T, axis=1)
    before = np.zeros((3, len(starts)))
    before[:, 1:] = left[:, starts[1:] - 1]
    left -= np.repeat(before, size, axis=1)
    last = starts + size - 1
    total = left[:, last]
    out.total[row_node[starts]] = total.T
    if spec.growth == "oblivious":
        return _shared_split(keys, sums, out, layout, spec, number)
    whole = np.repeat(total, size, axis=1)
    right = whole - left
    gain = _score(left[0], left[1], spec) + _score(right[0], right[1], spec) - np.repeat(_score(total[0], total[1], spec), size)
    ok = (right[2] >= max(spec.min_rows, 1)) & (left[2] >= spec.min_rows) & (whole[2] >= spec.min_split)
    ok &= (left[1] >= spec.min_weight) & (right[1] >= spec.min_weight)
    if spec.forest:  # an impure node is split even without a gain
        ok &= (whole[0] > 0) & (whole[0] < whole[1])
        gain = np.maximum(gain, 0.0)
        ok &= np.repeat(_node_features(row_node[starts], feature[starts], last > starts, layout.n_features, spec, number, nodes), size)
    else:
        ok &= (gain > 1e-6) & (gain >= spec.min_gain)
        if spec.colsample < 1:
            ok &= _tree_features(layout.n_features, spec, number)[feature]
    gain = np.where(ok, gain, -np.inf)
    begin = np.flatnonzero(np.concatenate([[True], row_node[1:] != row_node[:-1]]))
    most = np.maximum.reduceat(gain, begin)
    size = np.diff(np.concatenate([begin, [len(keys)]]))
    at = np.flatnonzero((gain == np.repeat(most, size)) & ok)
    if len(at):
        which, i = np.unique(row_node[at], return_index=True)
        at = at[i]
        out.gain[which], out.feature[which], out.cut[which], out.left[which] = gain[at], feature[at], place[at] - layout.offsets[feature[at]], left[:, at].T
    return out


def _shared_split(keys: np.ndarray, sums: np.ndarray, out: Splits, layout: "Layout", spec: Spec, number: int) -> Splits:
    """The one split with the highest sum of gains over all nodes."""
    n = len(out.gain)
    left = np.zeros((3, n * layout.width))
    left[:, keys] = sums.T
    left = left.reshape(3, n, layout.width)
    for a, b in zip(layout.offsets[:-1], layout.offsets[1:], strict=True):
        np.cumsum(left[:, :, a:b], axis=2, out=left[:, :, a:b])
    whole = out.total.T[:, :, None]
    right = whole - left
    gain = (_score(left[0], left[1], spec) + _score(right[0], right[1], spec) - _score(whole[0], whole[1], spec)).sum(0)
    ok = ((left[2] > 0) & (right[2] > 0)).any(0) & (gain > max(1e-6, spec.min_gain))
    if spec.colsample < 1:
        ok &= _tree_features(layout.n_features, spec, number)[layout.feature]
    if ok.any():
        best = int(np.where(ok, gain, -np.inf).argmax())
        f = layout.feature[best]
        out.gain[:], out.feature[:], out.cut[:], out.left = gain[best], f, best - layout.offsets[f], left[:, :, best].T
    return out


def _tree_features(n_features: int, spec: Spec, number: int) -> np.ndarray:
    n = max(1, math.ceil(n_features * spec.colsample - 1e-9))
    draw = _mixed(np.arange(n_features), spec.seed, number, 1)
    return np.isin(np.arange(n_features), np.argsort(draw, kind="stable")[:n])


def _node_features(node: np.ndarray, feature: np.ndarray, varied: np.ndarray, n_features: int, spec: Spec, number: int, nodes: np.ndarray) -> np.ndarray:
    """Which of the (node, feature) pairs take part: a draw among the features that vary in the node."""
    if spec.node_features is None:
        return varied
    n = {"sqrt": math.sqrt(n_features), "log2": math.log2(n_features) if n_features > 1 else 1}.get(spec.node_features, spec.node_features)
    n = max(1, int(n * n_features) if isinstance(spec.node_features, float) else int(n))
    draw = _mixed(nodes[node].astype(_U) * _U(n_features) + feature.astype(_U), spec.seed, number, 2)
    at = np.flatnonzero(varied)
    order = at[np.lexsort((draw[at], node[at]))]
    begin = np.flatnonzero(np.concatenate([[True], node[order][1:] != node[order][:-1]])) if len(order) else np.zeros(0, int)
    size = np.diff(np.concatenate([begin, [len(order)]]))
    place = np.arange(len(order)) - np.repeat(begin, size)
    out = np.zeros(len(node), bool)
    out[order[place < n]] = True
    return out


# ------------------------------------------------------------------------- growth, as questions and answers
def _grow(spec: Spec, number: int) -> Generator[tuple[Tree, np.ndarray], Splits, Tree]:
    """A tree; yields nodes whose best splits are wanted."""
    if spec.growth == "leaf":
        return (yield from _grow_by_leaf(spec))
    tree, nodes, depth = Tree(), np.zeros(1, np.int64), 0
    while len(nodes) and (spec.max_depth is None or depth < spec.max_depth or not depth):
        found = yield tree, nodes
        if not depth:
            tree.sums[0] = found.total[0]
        good = np.flatnonzero(found.feature >= 0) if spec.max_depth != 0 else np.zeros(0, int)
        if not len(good):
            break
        children = tree.split(nodes[good], found.feature[good], found.cut[good], found.left[good], found.total[good])
        if spec.growth != "oblivious":  # others can't be split
            s = tree.sums[children]
            can = (s[:, 2] >= max(spec.min_split, 2 * spec.min_rows, 2)) & (s[:, 1] >= 2 * spec.min_weight)
            if spec.forest:
                can &= (s[:, 0] > 0) & (s[:, 0] < s[:, 1])
            children = children[can]
        nodes, depth = children, depth + 1
    return tree


def _grow_by_leaf(spec: Spec) -> Generator[tuple[Tree, np.ndarray], Splits, Tree]:
    tree, gains, depth = Tree(), {}, {0: 0}
    nodes = np.zeros(1, np.int64)
    while True:
        found = yield tree, nodes
        if nodes[0] == 0:
            tree.sums[0] = found.total[0]
        good = np.flatnonzero(found.feature >= 0)
        for n in nodes.tolist():
            gains[n] = -np.inf
        for i in good.tolist():
            gains[int(nodes[i])] = float(found.gain[i])
        children = tree.split(nodes[good], found.feature[good], found.cut[good], found.left[good], found.total[good])
        for n, c in zip(nodes[good].tolist(), children[::2].tolist(), strict=True):
            depth[c] = depth[c + 1] = depth[n] + 1
        # take leaves from the queue in the order of their gains; what isn't known yet is asked for
        queue, taken, unknown = [(-gains[0], 0)], [], []
        most = (spec.num_leaves or 2**31) - 1
        while queue and len(taken) < most:
            gain, n = heapq.heappop(queue)
            if gain == np.inf:
                break
            taken.append(n)
            if len(taken) < most and (spec.max_depth is None or depth[n] + 1 < spec.max_depth):
                for c in (int(tree.left[n]), int(tree.left[n]) + 1):
                    if c in gains:
                        heapq.heappush(queue, (-gains[c], c))
                    else:
                        unknown.append(c)
        if not unknown:
            return tree.pruned(set(taken))
        nodes = np.array(sorted(unknown), np.int64)


def _boosted(spec: Spec, keep: bool) -> Generator[list[Ask], list[tuple[Splits | None, dict]], tuple[list[Tree], list[float]]]:
    trees, losses, commit = [], [], None
    for number in range(spec.n_trees):
        grow = _grow(spec, number)
        tree, nodes = next(grow)
        while True:
            (found, scored), = yield [Ask(number, tree, nodes, commit)]
            if commit is not None:
                commit = None
                if _stops(spec, losses, scored):
                    return trees[: int(np.argmin(losses)) + 1], losses
            try:
                tree, nodes = grow.send(found)
            except StopIteration as done:
                commit = done.value
                trees += [commit] * keep
                break
    if commit is not None:
        (_, scored), = yield [Ask(spec.n_trees, commit=commit)]
        _stops(spec, losses, scored)
    best = int(np.argmin(losses)) + 1 if spec.patience and losses else len(trees)
    return trees[:best], losses


def _stops(spec: Spec, losses: list[float], scored: dict) -> bool:
    if not scored.get("n"):
        return False
    losses.append(scored["loss"] / scored["n"])
    return bool(spec.patience) and len(losses) - 1 - int(np.argmin(losses)) >= spec.patience


def _forested(spec: Spec, together: int, keep: bool) -> Generator[list[Ask], list[tuple[Splits | None, dict]], tuple[list[Tree], list[float]]]:
    trees: list[Tree] = []
    for begin in range(0, spec.n_trees, together):
        grow = {n: _grow(spec, n) for n in range(begin, min(spec.n_trees, begin + together))}
        wanted = {n: next(g) for n, g in grow.items()}
        done: dict[int, Tree] = {}
        while wanted:
            order = sorted(wanted)
            replies = yield [Ask(n, *wanted[n]) for n in order]
            for n, (found, _) in zip(order, replies, strict=True):
                try:
                    wanted[n] = grow[n].send(found)
                except StopIteration as end:
                    done[n] = end.value
                    del wanted[n]
        yield [Ask(n, commit=done[n]) for n in sorted(done)]
        trees += [done[n] for n in sorted(done)] * keep
    return trees, []


def _questions(spec: Spec, together: int = TOGETHER, keep: bool = True):
    return _forested(spec, together, keep) if spec.forest else _boosted(spec, keep)


# ------------------------------------------------------------------------- a block's answers
class Layout:
    """Places of all features' bins, one feature after the other."""

    def __init__(self, bins: list[int]):
        self.bins, self.n_features = list(bins), len(bins)
        self.offsets = np.concatenate([[0], np.cumsum(bins)]).astype(np.int64)
        self.width = int(self.offsets[-1])
        self.feature = np.repeat(np.arange(len(bins)), bins)
        # features of few bins are counted together, by one code of all their bins
        self.most = 0  # codes of a bundle
        self.bundles: list[tuple[list[int], int, np.ndarray]] = []  # features, codes, and which of the features' bins a code adds to
        small = sorted(range(len(bins)), key=lambda f: bins[f])
        while small:
            group = [small.pop(0)]
            codes = bins[group[0]]
            while small and codes * bins[small[0]] <= MAX_BINS + 1:
                codes *= bins[small[0]]
                group.append(small.pop(0))
            adds = np.zeros((codes, sum(bins[f] for f in group)))
            at, step = 0, 1
            for f in group:
                adds[np.arange(codes), at + np.arange(codes) // step % bins[f]] = 1
                at, step = at + bins[f], step * bins[f]
            self.bundles.append((group, codes, adds))
            self.most = max(self.most, codes)

    def codes(self, columns: np.ndarray) -> np.ndarray:
        """Codes of every bundle (bundles x rows)."""
        out = np.zeros((len(self.bundles), columns.shape[1]), np.uint8)  # there are at most MAX_BINS + 1
        for b, (group, _, _) in enumerate(self.bundles):
            step = 1
            for f in group:
                out[b] += columns[f] * np.uint8(step)
                step *= self.bins[f]
        return out


@dataclass
class Totals:
    """What all blocks together hold: rows, rows and positives of each fold, and the features' bins."""

    rows: int
    folds: dict[int, tuple[int, int]]  # fold: rows, positives (of training rows)
    layout: Layout

    def of(self, held_out: int | None) -> tuple[int, int]:
        """Negatives and positives of a fit: the total less its own fold."""
        n = sum(r for r, _ in self.folds.values())
        p = sum(p for _, p in self.folds.values())
        if held_out is not None:
            n, p = n - self.folds.get(held_out, (0, 0))[0], p - self.folds.get(held_out, (0, 0))[1]
        return n - p, p

    def weights(self, spec: Spec) -> tuple[float, float]:
        """Weights of negatives and positives. The ratio is that of all training rows, as a caller sets it before any fold is made."""
        neg, pos = self.of(spec.held_out if spec.pos_weight == "balanced" else None)
        if spec.pos_weight == "none" or not neg or not pos:
            return 1.0, 1.0
        return (1.0, neg / pos) if spec.pos_weight == "ratio" else ((neg + pos) / (2 * neg), (neg + pos) / (2 * pos))

    def start(self, spec: Spec) -> float:
        (neg, pos), (wn, wp) = self.of(spec.held_out), self.weights(spec)
        return math.log(pos * wp / (neg * wn)) if spec.start == "average" and neg and pos else 0.0

    def scale(self, spec: Spec) -> float:
        return 2.0 ** (40 - math.ceil(math.log2(max(2.0, self.rows * max(self.weights(spec)) * 4))))


class Block:
    """Binned rows (features x rows), and the running scores of fits."""

    def __init__(self, columns: np.ndarray, y: np.ndarray, key: np.ndarray, fold: np.ndarray, part: np.ndarray):
        self.columns, self.y, self.key, self.fold, self.part = columns, y.astype(np.float64), key, fold, part
        self.scores: dict[int, np.ndarray] = {}
        self.cache: dict = {}

    def __getstate__(self):
        small = self.y.astype(np.int8)
        return {**self.__dict__, "cache": {}, "y": small if np.array_equal(small, self.y) else self.y}

    def __setstate__(self, state: dict):
        self.__dict__.update(state, y=state["y"].astype(np.float64))

    def rows(self, held_out: int | None) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Training rows of a fit and then those that it is judged by: how many train, bins of all, labels and keys of the first, labels of the others."""
        if ("rows", held_out) not in self.cache:
            train = self.part == TRAIN
            judge = self.part == VALIDATE if held_out is None else train & (self.fold == held_out)
            if held_out is not None:
                train = train & (self.fold != held_out)
            t, j = np.flatnonzero(train), np.flatnonzero(judge)
            if np.array_equal(np.concatenate([t, j]), np.arange(len(self.y))):  # they stand so already
                n = len(t)
                self.cache["rows", held_out] = n, self.columns, self.y[:n], self.key[:n], self.y[n:]
            else:
                self.cache["rows", held_out] = len(t), np.ascontiguousarray(self.columns[:, np.concatenate([t, j])]), self.y[t], self.key[t], self.y[j]
        return self.cache["rows", held_out]

    def codes(self, held_out: int | None, layout: Layout) -> np.ndarray:
        """Codes of a fit's training rows (bundles x rows)."""
        if ("rows", held_out, "codes") not in self.cache:
            n, columns, *_ = self.rows(held_out)
            self.cache["rows", held_out, "codes"] = layout.codes(columns[:, :n])
        return self.cache["rows", held_out, "codes"]

    def draws(self, spec: Spec, *salt: int) -> np.ndarray:
        """A uniform number for every training row."""
        at = ("rows", spec.held_out, "seed", spec.seed)
        if at not in self.cache:
            self.cache[at] = _mixed(self.rows(spec.held_out)[3], spec.seed)
        return _uniform(self.cache[at], *salt)

    def committed(self, fit: int, spec: Spec, totals: Totals, asks: list[Ask]) -> dict:
        """Add finished trees to the fit's scores (of a forest those of the judging rows only); how its judging rows do then."""
        n, columns, _, _, y = self.rows(spec.held_out)
        if fit not in self.scores:
            self.scores[fit] = np.full(columns.shape[1], totals.start(spec))
        done = [a for a in asks if a.commit is not None]
        if not done:
            return {}
        s = self.scores[fit]
        for a in done:
            values = a.commit.values(spec)
            if spec.forest:
                s[n:] += values.take(a.commit.route(columns[:, n:]))
            else:
                grown = self.cache.get((fit, a.number - 1))
                s += values.take(a.commit.route(columns) if grown is None else grown.leaves(a.commit))
        s = s[n:]
        if spec.forest:
            n = max(a.number for a in done) + 1
            loss = np.zeros(0)
            hit = s > n / 2
        else:
            loss = np.maximum(s, 0) - s * y + np.log1p(np.exp(-np.abs(s)))
            hit = s > 0
        return {"n": len(y), "loss": float(np.rint(loss * 2**20).sum() / 2**20), "tp": int((hit & (y == 1)).sum()), "fp": int((hit & (y == 0)).sum()), "fn": int((~hit & (y == 1)).sum())}

    def gradients(self, fit: int, spec: Spec, totals: Totals, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gradient, hessian and which training rows the tree sees; of a forest weight x label, weight."""
        _, _, y, *_ = self.rows(spec.held_out)
        neg, pos = totals.weights(spec)
        w = np.where(y == 1, pos, neg)
        scale = totals.scale(spec)

        def rounded(x: np.ndarray) -> np.ndarray:
            x *= scale
            np.rint(x, x)
            x /= scale
            return x

        if spec.forest:
            n = np.searchsorted(_POISSON, self.draws(spec, number), "right")
            w = rounded(w * n)
            return w * y, w, n > 0
        p = np.negative(self.scores[fit][: len(y)])
        np.exp(p, p)
        p += 1
        np.divide(1, p, p)
        seen = np.ones(len(y), bool) if spec.subsample >= 1 else self.draws(spec, number // spec.subsample_every, 3) < spec.subsample
        g, h = p - y, w * p
        g *= w
        h *= np.subtract(1, p, p)
        return rounded(g), rounded(h), seen

    def histogram(self, fit: int, spec: Spec, totals: Totals, ask: Ask) -> tuple[np.ndarray, np.ndarray]:
        """Keys (see ``best_splits``) and sums of gradient, hessian and rows, for the asked nodes."""
        mine = self.cache.get((fit, ask.number))
        if mine is None:
            for k in [k for k in self.cache if k[0] == fit and not spec.forest]:
                del self.cache[k]
            n, columns, *_ = self.rows(spec.held_out)
            codes = self.codes(spec.held_out, totals.layout)
            g, h, seen = self.gradients(fit, spec, totals, ask.number)
            if spec.forest:  # no other rows are needed
                rows = np.flatnonzero(seen)
                columns, codes, g, h, seen = columns.take(rows, axis=1), codes.take(rows, axis=1), g.take(rows), h.take(rows), None
            mine = self.cache[fit, ask.number] = Growing(columns, codes, g, h, None if spec.subsample >= 1 else seen)
        return mine.sums(ask, totals.layout, spec)


class Growing:
    """Where the rows of a growing tree are, and the sums of the nodes that may be split.

    Sums are exact, so that of two children only the one of fewer rows is counted: the other has what is left of
    their parent's sums.
    """

    def __init__(self, columns: np.ndarray, codes: np.ndarray, g: np.ndarray, h: np.ndarray, seen: np.ndarray | None):
        self.columns, self.codes, self.g, self.h = columns, codes, g, h  # rows that are only judged come last, without gradients
        self.seen = seen  # which of the others are counted, if not all
        self.node = np.zeros(columns.shape[1], np.int64)
        self.tree, self.size = Tree(), 0  # as it was last followed
        self.known = np.zeros(0, np.int64)  # nodes whose sums are kept
        self.table = np.zeros((3, 0, 0))

    def leaves(self, tree: Tree) -> np.ndarray:
        """Leaf of every row in the finished tree."""
        self._follow(self.tree)
        return self.node if tree is self.tree else tree.origin.take(self.node)

    def _follow(self, tree: Tree) -> None:
        """Rows go on into the nodes that the tree got since: one step, if it was followed before."""
        if len(tree.left) > self.size:
            self.node = tree.route(self.columns, self.node, 1 if self.size or len(tree.left) == 3 else None)
        self.tree, self.size = tree, len(tree.left)

    def _only(self, rows: np.ndarray) -> None:
        self.columns, self.codes, self.g, self.h, self.node = self.columns.take(rows, axis=1), self.codes.take(rows, axis=1), self.g.take(rows), self.h.take(rows), self.node.take(rows)

    def sums(self, ask: Ask, layout: Layout, spec: Spec) -> tuple[np.ndarray, np.ndarray]:
        """Keys (see ``best_splits``) and sums of gradient, hessian and rows, for the asked nodes."""
        tree, nodes, width = ask.tree, ask.nodes, layout.width
        self._follow(tree)
        size = self.size
        other = np.maximum(nodes + np.where(nodes % 2 == 1, 1, -1), 0)  # the other child of the parent: they stand next to each other
        if spec.forest and size > 1:  # rows of other nodes aren't asked for again
            wanted = np.zeros(size, bool)
            wanted[nodes] = wanted[other] = True
            stay = wanted.take(self.node)
            if 4 * np.count_nonzero(stay) < 3 * len(stay):
                self._only(np.flatnonzero(stay))
        here = self.node[: len(self.g)]
        place = np.full(size, -1, np.int64)
        place[nodes] = np.arange(len(nodes))
        if len(self.known):  # all rows of the tree are here
            n = int(tree.sums[nodes, 2].sum())
        else:
            asked = place.take(here) >= 0
            n = np.count_nonzero(asked if self.seen is None else asked & self.seen)
        if not n:
            return np.zeros(0, np.int64), np.zeros((0, 3))
        if len(nodes) * width > 4 * layout.n_features * n + 1024:  # a dense table would be larger than the rows
            self.known, self.table = np.zeros(0, np.int64), np.zeros((3, 0, 0))
            at = place.take(here)
            rows = np.flatnonzero(at >= 0 if self.seen is None else (at >= 0) & self.seen)
            return _sparse_sums(at.take(rows), self.columns.take(rows, axis=1), self.g.take(rows), self.h.take(rows), layout)
        kept = np.full(size, -1, np.int64)
        kept[self.known] = np.arange(len(self.known))
        parent = np.full(size, -1, np.int64)
        inner = np.flatnonzero(tree.left >= 0)
        parent[tree.left[inner]] = parent[tree.left[inner] + 1] = inner
        above = parent[nodes]
        left_over = (above >= 0) & (kept[above] >= 0) & (len(nodes) * width <= n)  # of many small nodes, tables take longer than rows
        a, b = tree.sums[nodes, 2], tree.sums[other, 2]
        left_over &= (a > b) | ((a == b) & (nodes > other))
        counted = np.unique(np.concatenate([nodes[~left_over], other[left_over]]))
        place[:] = -1
        place[counted] = np.arange(len(counted))
        at = (place * layout.most).take(here)
        rows = np.flatnonzero(at >= 0 if self.seen is None else (at >= 0) & self.seen)
        if len(rows) == len(here):
            table = _dense_sums(at, self.codes, self.g, self.h, len(counted), layout)
        else:
            table = _dense_sums(at.take(rows), self.codes.take(rows, axis=1), self.g.take(rows), self.h.take(rows), len(counted), layout)
        out = table
        if left_over.any():
            out = table.take(place[nodes], axis=1)  # of nodes that are not counted it is replaced
            out[:, left_over] = self.table.take(kept[above[left_over]], axis=1) - table.take(place[other[left_over]], axis=1)
        if spec.growth == "leaf" and len(self.known):  # children of some may be asked for later
            later = tree.left[self.known] < 0
            self.known, self.table = np.concatenate([self.known[later], nodes]), np.concatenate([self.table[:, later], out], 1)
        else:
            self.known, self.table = nodes, out
        if self.table.nbytes > KEPT:
            self.known, self.table = np.zeros(0, np.int64), np.zeros((3, 0, 0))
        out = out.reshape(3, -1)
        keys = np.flatnonzero(out[2])
        return keys, out.take(keys, axis=1).T


def _dense_sums(at: np.ndarray, codes: np.ndarray, g: np.ndarray, h: np.ndarray, n_nodes: int, layout: Layout) -> np.ndarray:
    """Sums of gradient, hessian and rows (3 x nodes x places); ``at`` counts nodes in steps of ``layout.most``."""
    table = np.empty((3, n_nodes, layout.width))
    for (group, width, adds), code in zip(layout.bundles, codes, strict=True):
        place = at + code
        for c, w in enumerate((g, h, None)):
            some = np.bincount(place, w, n_nodes * layout.most).reshape(n_nodes, layout.most)[:, :width]
            if len(group) > 1:
                some = some @ adds  # whole multiples of one power of two: exact
            begin = 0
            for f in group:
                table[c, :, layout.offsets[f]: layout.offsets[f + 1]] = some[:, begin: begin + layout.bins[f]]
                begin += layout.bins[f]
    return table


def _sparse_sums(at: np.ndarray, columns: np.ndarray, g: np.ndarray, h: np.ndarray, layout: Layout) -> tuple[np.ndarray, np.ndarray]:
    n_features, n = columns.shape
    keys = (at * layout.width)[None] + layout.offsets[:-1, None] + columns
    shift = max(1, (n_features * n - 1).bit_length())
    order = np.sort((keys.ravel() << shift) | np.arange(n_features * n))  # by key, with the place of its row
    keys, row = order >> shift, (order & ((1 << shift) - 1)) % n
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sums = np.stack([np.add.reduceat(g[row], starts), np.add.reduceat(h[row], starts), np.diff(np.concatenate([starts, [len(keys)]]))], 1)
    return keys[starts], sums


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = max((int(k[-1]) + 1 for k in (a[0], b[0]) if len(k)), default=0)
    if n <= 4 * (len(a[0]) + len(b[0])):  # keys rise and are dense: no need to sort them
        table = np.zeros((n, 3))
        table[a[0]] = a[1]
        table[b[0]] += b[1]
        keys = np.flatnonzero(table[:, 2])  # every key has rows
        return keys, table[keys]
    keys = np.concatenate([a[0], b[0]])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    sums = np.add.reduceat(np.concatenate([a[1], b[1]])[order], starts, axis=0) if len(keys) else a[1]
    return keys[starts], sums


def _added(a: dict, b: dict) -> dict:
    return {k: a.get(k, 0) + b.get(k, 0) for k in a.keys() | b.keys()}


def _chosen(found: tuple[np.ndarray, np.ndarray], spec: Spec, totals: Totals, ask: Ask) -> Splits:
    return best_splits(*found, len(ask.nodes), totals.layout, spec, ask.number, ask.nodes)


def _fit_in_block(block: Block, fit: int, spec: Spec, totals: Totals, seen: dict[int, dict] | None = None, keep: bool = True) -> tuple[list[Tree], list[float], dict]:
    """A whole fit on the only block; ``seen`` gets how the judging rows do after each of its numbers of trees."""
    questions = _questions(spec, 1, keep)
    scored: dict = {}
    grown = 0
    try:
        asks = next(questions)
        while True:
            scored = block.committed(fit, spec, totals, asks) or scored
            grown += sum(a.commit is not None for a in asks)
            if seen and grown in seen:
                seen[grown] = scored
            replies = [(_chosen(block.histogram(fit, spec, totals, a), spec, totals, a) if a.tree is not None else None, scored) for a in asks]
            if spec.forest:  # nothing of a finished tree is needed again
                block.cache = {k: v for k, v in block.cache.items() if k[0] == "rows" or not any(a.commit is not None for a in asks)}
            asks = questions.send(replies)
    except StopIteration as done:
        block.scores.pop(fit, None)
        block.cache = {k: v for k, v in block.cache.items() if k[0] == "rows"}
        return (*done.value, scored)


# ------------------------------------------------------------------------- data and models
@dataclass
class Data:
    """Binned rows of one table: cuts of each feature, totals, and the blocks as written files."""

    spark: SparkSession
    columns: list[str]
    cuts: list[np.ndarray]
    totals: Totals
    path: str
    n_blocks: int

    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(self.path)


def binned(columns: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x, "left").astype(np.uint8) for c, x in zip(cuts, columns, strict=True)]) if len(cuts) else np.zeros((0, columns.shape[1]), np.uint8)


def feature_cuts(df: DataFrame, columns: list[str], max_bins: int = MAX_BINS) -> list[np.ndarray]:
    """At most ``max_bins - 1`` cuts of each feature: a value falls into the first bin whose cut isn't below it.

    Features of few values get a cut at each value but the largest.
    """
    at = [(i + 1) / max_bins for i in range(max_bins)]
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), at, 20 * max_bins).alias(f"q{i}") for i, c in enumerate(columns)],
                 *[F.max(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return [np.array(sorted({float(x) for x in row[f"q{i}"] or [] if x < row[f"m{i}"]})) for i in range(len(columns))]


def prepare(df: DataFrame, columns: list[str], label: str = "y", id_col: str = "id", fold: str | None = None, part: str | None = None, max_bins: int = MAX_BINS) -> Data:
    """Bin the rows of ``df`` and write them in blocks. NULL features or labels raise.

    ``fold`` numbers the folds of a cross-validation, ``part`` is 0 for training rows and 1
    for validation rows. Cuts come from the training rows.
    """
    spark = df.sparkSession
    root = checkpoint_dir(spark).rstrip("/")
    part_col = F.col(part).cast("int") if part else F.lit(TRAIN)
    fold_col = F.col(fold).cast("int") if fold else F.lit(0)
    rows = df.select(F.xxhash64(F.col(id_col).cast("string")).alias("key"), F.col(label).cast("double").alias("y"), fold_col.alias("fold"), part_col.alias("part"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))
    cuts = feature_cuts(df.where(part_col == TRAIN), columns, max_bins)
    n = rows.count()
    size = WHOLE * BLOCK if _held(n, len(columns)) else min(BLOCK, CUT)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[dict[str, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            whole = {c: np.concatenate([g[c] for g in got], axis=-1) for c in got[0]}
            if whole["part"].any():  # training rows first, as fits take them
                order = np.argsort(whole["part"], kind="stable")
                whole = {c: np.ascontiguousarray(x[..., order]) for c, x in whole.items()}
            raw = io.BytesIO()
            np.savez(raw, **whole)
            return pa.RecordBatch.from_pydict({"block": pa.array([raw.getvalue()], pa.binary()), "n": pa.array([len(whole["y"])], pa.int64())})

        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(columns)).T
            y = batch.column("y").to_numpy(zero_copy_only=False)
            if np.isnan(x).any() or np.isnan(y).any():
                raise ValueError("features and labels must not be NULL or NaN")
            for a in range(0, batch.num_rows, size):
                s = slice(a, a + size)
                if got and sum(len(g["y"]) for g in got) + len(y[s]) > size:
                    yield out()
                    got.clear()
                got.append({"columns": binned(x[:, s], cuts), "y": y[s], "key": batch.column("key").to_numpy().view(_U)[s], "fold": batch.column("fold").to_numpy()[s], "part": batch.column("part").to_numpy()[s]})
        if got:
            yield out()

    path = f"{root}/binned-{uuid.uuid4().hex}"
    parts = max(1, math.ceil(n / size * (1.1 if n > size else 1)))
    rows.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(pack, "block binary, n long").write.parquet(path)
    folds = {r.fold: (r.n, r.p) for r in df.where(part_col == TRAIN).groupBy(fold_col.alias("fold")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("p")).collect()}
    return Data(spark, list(columns), cuts, Totals(n, folds, Layout([len(c) + 1 for c in cuts])), path, spark.read.parquet(path).count())


def _block(*raw: bytes) -> Block:
    """The rows of one block or several."""
    some = [np.load(io.BytesIO(r)) for r in raw]
    return Block(**{c: np.concatenate([x[c] for x in some], axis=-1) if len(some) > 1 else some[0][c] for c in some[0]})


@dataclass
class TreeModel:
    """A fitted model: scores rows of the columns that it was fitted on."""

    spec: Spec
    columns: list[str]
    cuts: list[np.ndarray]
    trees: list[Tree]
    start: float
    losses: list[float] = field(default_factory=list)  # of the validation rows, after each tree
    judged: dict = field(default_factory=dict)  # rows, loss, tp, fp, fn of the validation rows or the fold left out

    @property
    def f1(self) -> float:
        tp, fp, fn = (self.judged.get(k, 0) for k in ("tp", "fp", "fn"))
        return 2 * tp / (2 * tp + fp + fn) if tp else 0.0

    def probabilities(self, columns: np.ndarray) -> np.ndarray:
        """Of class 1, for binned rows (features x rows)."""
        s = np.full(columns.shape[1], self.start)
        for t in self.trees:
            s += t.values(self.spec)[t.route(columns)]
        return s / max(1, len(self.trees)) if self.spec.forest else 1 / (1 + np.exp(-s))

    def predict(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """``keep`` and ``score``, the probability of class 1."""
        size = sum(t.left.nbytes + t.feature.nbytes + t.bin.nbytes + t.sums.nbytes for t in self.trees)
        if size > MAX_MODEL:
            raise ValueError(f"a model of {size} bytes is too large to be sent to all tasks")
        model = df.sparkSession.sparkContext.broadcast(self)
        rows = df.select(*keep, F.array(*[F.col(c).cast("double") for c in self.columns]).alias("_x"))
        n = len(self.columns)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = model.value
            for batch in batches:
                x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, n).T
                p = m.probabilities(binned(x, m.cuts))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(p, pa.float64())], [*keep, "score"])

        return rows.mapInArrow(run, rows.select(*keep, F.lit(0.0).alias("score")).schema)

    def save(self, spark: SparkSession, path: str) -> None:
        """Two Parquet tables: nodes of all trees, and settings with cuts."""
        rows = [(i, n, int(t.feature[n]), int(t.bin[n]), int(t.left[n]), *map(float, t.sums[n])) for i, t in enumerate(self.trees) for n in range(len(t.left))]
        spark.createDataFrame(rows, "tree int, node int, feature int, bin int, left int, g double, h double, rows double").write.mode("overwrite").parquet(f"{path}/nodes")
        spec = {k: None if v is None else str(v) for k, v in self.spec.__dict__.items()}
        meta = [(spec, self.columns, [c.tolist() for c in self.cuts], self.start)]
        spark.createDataFrame(meta, "spec map<string,string>, columns array<string>, cuts array<array<double>>, start double").write.mode("overwrite").parquet(f"{path}/settings")


def load(spark: SparkSession, path: str) -> TreeModel:
    """A model that ``TreeModel.save`` wrote."""
    meta = spark.read.parquet(f"{path}/settings").first()
    kinds = {"int": int, "float": float, "str": str}
    values = {}
    for k, f in Spec.__dataclass_fields__.items():
        v, kind = meta.spec.get(k), f.type.split(" | ")[0]
        values[k] = None if v is None else (_number_or_name(v) if k == "node_features" else kinds[kind](v))
    t = spark.read.parquet(f"{path}/nodes").toPandas().sort_values(["tree", "node"])
    trees = []
    for _, g in t.groupby("tree"):
        tree = Tree()
        tree.feature, tree.bin, tree.left = (g[c].to_numpy(np.int32) for c in ("feature", "bin", "left"))
        tree.sums = g[["g", "h", "rows"]].to_numpy(np.float64)
        trees.append(tree)
    return TreeModel(Spec(**values), list(meta.columns), [np.array(c, float) for c in meta.cuts], trees, meta.start)


def _number_or_name(v: str) -> str | float:
    try:
        return float(v)
    except ValueError:
        return v


# ------------------------------------------------------------------------- all fits in one pass
def fit_many(data: Data, specs: list[Spec], keep: bool = True) -> list[TreeModel]:
    """Fit all settings at once; the models in their order.

    Without ``keep`` they hold no trees, only how their judging rows do: the trees of a search's many fits are
    larger than a task or the driver could hold.
    """
    sc = data.spark.sparkContext
    if data.n_blocks == 1 or _held(data.totals.rows, len(data.columns)):
        found = _in_tasks(data, specs, sc, keep)
    else:
        found = _in_passes(data, specs, sc, keep)
    return [TreeModel(s, data.columns, data.cuts, trees, data.totals.start(s), losses, judged) for s, (trees, losses, judged) in zip(specs, found, strict=True)]


def _held(rows: int, n_columns: int) -> bool:
    """A task can hold so many rows, however many blocks they came to."""
    return rows <= WHOLE * BLOCK and rows * (n_columns + 32) <= HELD


def _cost(spec: Spec) -> float:
    return spec.n_trees * (spec.max_depth or 20) * (3 if spec.forest else 1)


def _in_tasks(data: Data, specs: list[Spec], sc, keep: bool = True) -> list:
    raw = sc.broadcast([bytes(r["block"]) for r in data.blocks().select("block").collect()])  # at most WHOLE * BLOCK rows
    totals = data.totals
    same: dict[Spec, list[int]] = {}  # fits that differ in the number of trees are beginnings of the longest
    for i, s in enumerate(specs):
        same.setdefault(s if s.patience else replace(s, n_trees=0), []).append(i)
    groups = sorted((sorted(g, key=lambda i: -specs[i].n_trees) for g in same.values()), key=lambda g: -_cost(specs[g[0]]))

    def run(items: Iterator[list[int]]):
        block = _block(*raw.value)
        for first, *others in items:
            seen = {specs[i].n_trees: {} for i in others if specs[i].n_trees}
            grown, losses, scored = _fit_in_block(block, first, specs[first], totals, seen, keep)
            yield first, (grown, losses, scored)
            for i in others:
                n = len(grown) if specs[i].patience else specs[i].n_trees
                yield i, (grown[:n], losses if specs[i].patience else losses[:n], scored if specs[i].patience or n >= specs[first].n_trees else seen.get(n, {}))

    tasks = min(len(groups), 8 * sc.defaultParallelism)
    dealt = [groups[t::tasks] for t in range(tasks)]
    found = dict(sc.parallelize(dealt, tasks).flatMap(lambda x: run(iter(x))).collect())
    raw.unpersist()
    return [found[i] for i in range(len(specs))]


def _in_passes(data: Data, specs: list[Spec], sc, keep: bool = True) -> list:
    totals = data.totals
    questions = {i: _questions(s, max(TOGETHER, ALONE // len(specs)), keep) for i, s in enumerate(specs)}
    asks = {i: next(q) for i, q in questions.items()}
    found: dict[int, tuple] = {}
    scored: dict[int, dict] = {i: {} for i in asks}
    checkpoint_dir(data.spark)
    state = data.blocks().select("block").rdd.map(lambda r: _block(bytes(r[0]))).persist(StorageLevel.MEMORY_AND_DISK)
    passes = 0
    while asks:
        sent = _Sent(sc, {i: (specs[i], a) for i, a in asks.items()})
        old = state
        changed = any(a.commit is not None for some in asks.values() for a in some) or not passes
        if changed:
            state = state.map(lambda b, sent=sent: _with_commits(b, sent.value, totals)).persist(StorageLevel.MEMORY_AND_DISK)
            if passes % CHECKPOINT == CHECKPOINT - 1:
                state.checkpoint()
            passes += 1
        # sums of few nodes are added up on the driver: a shuffle takes longer than they do
        if sum(len(a.nodes) for some in asks.values() for a in some if a.nodes is not None) * totals.layout.width * 32 * data.n_blocks <= SMALL:
            sums: dict = {}
            for got in state.mapPartitions(lambda some, sent=sent: [_in_sum(x for b in some for x in _answers(b, sent.value, totals))]).collect():
                sums = _in_sum(got.items(), sums)
            replies = dict(_reply(kv, sent.value, totals) for kv in sums.items())
        else:
            n = min(max(1, sum(len(a) for a in asks.values())), sc.defaultParallelism)
            partial = state.flatMap(lambda b, sent=sent: _answers(b, sent.value, totals))
            replies = dict(partial.reduceByKey(_both, n).map(lambda kv, sent=sent: _reply(kv, sent.value, totals)).collect())
        if changed:
            old.unpersist()
        for i in list(asks):
            got = [replies.get((i, a.number), (None, {})) for a in asks[i]]
            scored[i] = next((s for _, s in got if s), scored[i])
            got = [(f if f is not None or a.tree is None else _chosen((np.zeros(0, np.int64), np.zeros((0, 3))), specs[i], totals, a), s) for a, (f, s) in zip(asks[i], got, strict=True)]
            try:
                asks[i] = questions[i].send(got)
            except StopIteration as done:
                found[i] = (*done.value, scored[i])
                del asks[i]
        sent.unpersist()
    state.unpersist()
    return [found[i] for i in range(len(specs))]


class _Sent:
    """Questions for the tasks: a few go with the task, many as a broadcast."""

    def __init__(self, sc, asks: dict[int, tuple[Spec, list[Ask]]]):
        trees = [t for _, some in asks.values() for a in some for t in (a.tree, a.commit) if t is not None]
        self._shared = sc.broadcast(asks) if len(asks) > 4 or sum(len(t.left) for t in trees) * 64 > SMALL >> 8 else None
        self._own = asks if self._shared is None else None

    @property
    def value(self) -> dict[int, tuple[Spec, list[Ask]]]:
        return self._own if self._shared is None else self._shared.value

    def unpersist(self) -> None:
        if self._shared is not None:
            self._shared.unpersist()


def _both(a: tuple, b: tuple) -> tuple:
    return (_merged(a[0], b[0]) if a[0] is not None else None), _added(a[1], b[1])


def _in_sum(answers, sums: dict | None = None) -> dict:
    """Answers added up by fit and tree."""
    sums = {} if sums is None else sums
    for k, v in answers:
        sums[k] = _both(sums[k], v) if k in sums else v
    return sums


def _with_commits(block: Block, sent: dict, totals: Totals) -> Block:
    out = Block(block.columns, block.y, block.key, block.fold, block.part)
    out.scores = {k: v.copy() for k, v in block.scores.items() if k in sent}
    out.judged = {i: out.committed(i, spec, totals, asks) for i, (spec, asks) in sent.items()}
    return out


def _answers(block: Block, sent: dict, totals: Totals):
    for i, (spec, asks) in sent.items():
        for n, a in enumerate(asks):
            scored = block.judged[i] if n == 0 and a.commit is not None else {}
            yield (i, a.number), (block.histogram(i, spec, totals, a) if a.tree is not None else None, scored)
        block.cache = {k: v for k, v in block.cache.items() if k[0] == "rows"}


def _reply(kv: tuple, sent: dict, totals: Totals):
    (i, number), (found, scored) = kv
    spec, asks = sent[i]
    ask = next(a for a in asks if a.number == number)
    return (i, number), (None if found is None else _chosen(found, spec, totals, ask), scored)
