"""Growing trees: one job for each level of a tree, or for the next few leaves of leaf-wise growth, over blocks of rows.

A task routes its rows through the tree so far and sums gradients into flat arrays of nodes x features x bins, which
are added up before they reach the driver. Only the smaller child of a node is counted, its sibling is the parent less
it. Rows carry the raw score up to the last stored round; trees since then are applied in the task, so a round changes
no rows, and every few rounds the blocks are written anew, which also ends their lineage.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.losses import Loss, base_score
from ..operators.binning import BinParams, BinSchema, Feature, column_of, fit_schema, key_of
from ..operators.splits import SplitParams, category_set
from ..sources.storage import dropped, written
from .blocks import Block, group_percentiles, kth, ordered_bits, packed, rows_of, summed, with_raw
from .model import Model, Tree, natural
from .ordered import grow_ordered, numbered


@dataclass(frozen=True)
class TreeParams:
    grow_policy: str = "depthwise"
    max_depth: int = 6
    max_leaves: int = 0
    split: SplitParams = SplitParams()
    subsample: float = 1.0
    bootstrap: bool = False
    colsample_bytree: float = 1.0
    colsample_bynode: float = 1.0
    seed: int = 0
    cat_split: str = "ordinal"
    cat_smooth: float = 10.0
    cat_l2: float = 10.0
    max_cat_threshold: int = 32
    max_cat_to_onehot: int = 4
    min_data_per_group: int = 100
    symmetric_score: str = "cosine"
    boosting_type: str = "plain"
    leaf_estimation_iterations: int = 1
    bootstrap_type: str = "none"
    bagging_temperature: float = 1.0
    mvs_reg: float | None = None
    random_strength: float = 0.0
    model_size_reg: float = 0.5
    one_hot_max_size: int = 2
    max_ctr_complexity: int = 1
    linear_leaves: bool = False
    lin_leaf_lambda: float = 1.0
    lin_leaf_max_terms: int = 8
    colsample_bylevel: float = 1.0

    def __post_init__(self):
        if self.grow_policy not in ("depthwise", "lossguide", "symmetric"):
            raise ValueError(f"unknown grow_policy {self.grow_policy}")
        if self.max_depth < 0 or (self.max_depth == 0 and self.max_leaves == 0):
            raise ValueError("a tree needs max_depth or max_leaves")
        if not 0 < self.subsample <= 1 or not 0 < self.colsample_bytree <= 1 or not 0 < self.colsample_bynode <= 1:
            raise ValueError("sampling rates must be over 0 and at most 1")
        if not 0 < self.colsample_bylevel <= 1 or self.max_ctr_complexity not in (1, 2):
            raise ValueError("colsample_bylevel must be over 0 and at most 1, max_ctr_complexity 1 or 2")
        if self.boosting_type not in ("plain", "ordered") or self.boosting_type == "ordered" and (self.grow_policy != "symmetric" or self.bootstrap_type != "none" or self.random_strength):
            raise ValueError("boosting_type is plain or ordered; ordered goes with symmetric trees, without bootstrap or noise")
        if self.bootstrap_type not in ("none", "bernoulli", "bayesian", "mvs") or self.leaf_estimation_iterations < 1 or min(self.bagging_temperature, self.random_strength, self.model_size_reg) < 0:
            raise ValueError("bootstrap_type is none, bernoulli, bayesian or mvs; leaf_estimation_iterations at least 1; the others not negative")
        if self.linear_leaves and self.grow_policy == "symmetric":
            raise ValueError("symmetric trees have no linear leaves")
        if self.split.learning_rate <= 0 or self.split.reg_lambda < 0:
            raise ValueError("learning_rate must be positive, lambda not negative")


@dataclass(frozen=True)
class BoostParams:
    n_rounds: int = 500
    loss: Loss = field(default_factory=Loss)
    tree: TreeParams = field(default_factory=TreeParams)
    bins: BinParams = field(default_factory=BinParams)
    sampling: str = "uniform"
    top_rate: float = 0.2
    other_rate: float = 0.1
    goss_rank: str = "gradient"
    goss_warmup: bool = True
    early_stopping_rounds: int = 0
    eval_metric: str = ""
    base_score: float | None = None
    store_every: int = 8

    def __post_init__(self):
        if self.sampling not in ("uniform", "goss") or self.goss_rank not in ("gradient", "gradient_hessian"):
            raise ValueError("sampling is uniform or goss, goss_rank gradient or gradient_hessian")
        if self.top_rate < 0 or self.other_rate <= 0 or self.top_rate + self.other_rate > 1:
            raise ValueError("top_rate and other_rate must sum to 1 at most")


def _gradients(loss: Loss, raw: np.ndarray, y: np.ndarray, w: np.ndarray, c: int) -> tuple[np.ndarray, np.ndarray]:
    """The same derivatives as functions.losses, over arrays."""
    k, r = loss.objective, raw[:, c]
    if k == "softmax":
        p = natural("softmax", raw)[:, c]
        g = (p - (y == c)) * w
        return g, np.maximum(2 * p * (1 - p) * w, 1e-16) if loss.softmax_hessian == "xgboost" else raw.shape[1] / (raw.shape[1] - 1) * p * (1 - p) * w
    d = r - y
    if k == "logistic":
        p, up = 1 / (1 + np.exp(-r)), np.where(y > 0.5, loss.scale_pos_weight, 1.0)
        g, h = up * (p - y), up * np.maximum(p * (1 - p), 1e-6)
    elif k == "squared_error":
        g, h = d, np.ones_like(d)
    elif k == "absolute_error":
        g, h = np.sign(d), np.ones_like(d)
    elif k == "quantile":
        g, h = np.where(d >= 0, 1 - loss.quantile_alpha, -loss.quantile_alpha), np.ones_like(d)
    elif k == "pseudo_huber":
        s2 = loss.huber_slope**2
        root = np.sqrt(1 + d * d / s2)
        g, h = d / root, s2 / ((s2 + d * d) * root)
    else:
        g, h = np.exp(r) - y, np.exp(r + loss.poisson_max_delta_step)
    return g * w, h * w


def _lot(rows: np.ndarray, seed: int) -> np.ndarray:
    """A number in [0, 1) for each row id and seed, the same on every machine."""
    with np.errstate(over="ignore"):
        x = rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed % (1 << 63)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(29)
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def _lot_bits(rows: np.ndarray, seed: int) -> np.ndarray:
    return (_lot(rows, seed) * float(1 << 53)).astype(np.uint64)


@dataclass
class _State:
    """What a task needs: trees not yet in the rows' raw scores, the tree that grows, and which nodes are wanted."""

    width: int
    pending: list[Tree]
    trees: list[Tree]  # growing, one for each class or, in a forest, for each tree of the job
    wanted: list[dict[int, int]]  # node -> slot
    offsets: np.ndarray
    loss: Loss
    params: TreeParams
    seeds: list[int]
    forest: bool
    cuts: list[tuple | None] = field(default_factory=list)  # of each tree: which rows it samples, see _cut and _goss_cut
    rank: str = "gradient"


def _raw(s: _State, b: Block) -> np.ndarray:
    return _advanced(b, s.pending, s.width)


def _advanced(b: Block, trees: list[Tree], width: int) -> np.ndarray:
    """Raw scores with more trees; of ordered boosting also those of the prefixes, which stand after the model's."""
    if not trees:
        return b.raw
    out = b.raw.copy()
    for i, t in enumerate(trees):
        out[:, i % width] += t.predict(b.bins)
        if getattr(t, "prefix", None) and out.shape[1] > width:
            leaf = t.leaves(b.bins)
            for j, (tail, values) in enumerate(t.prefix):
                out[:, width + j] += np.where(b.row < tail, values[leaf], 0.0)
    return out


def _sampled(s: _State, k: int, b: Block, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multiplies g, h and counts by what a row stands for in the tree."""
    cut = s.cuts[k] if s.cuts else None
    if s.params.grow_policy == "symmetric" and s.params.bootstrap_type != "none":  # what a row weighs when tests are scored
        u = np.maximum(_lot(b.row, s.seeds[k]), 2.0**-53)
        if s.params.bootstrap_type == "bernoulli":
            n = (u < s.params.subsample).astype(float)
        elif s.params.bootstrap_type == "bayesian":
            n = (-np.log(u)) ** s.params.bagging_temperature
        else:
            size = np.sqrt(g * g + cut[2])
            chance = np.minimum(1.0, size / cut[1]) if cut[1] > 0 else np.ones(len(u))
            n = np.where(u < chance, 1 / np.maximum(chance, 1e-300), 0.0)
        return g * n, h * n, n
    if s.params.bootstrap:  # each row's draws with replacement follow Poisson(rate), the limit of drawing round(n * rate)
        u, n, term, cum, i = _lot(b.row, s.seeds[k]), np.zeros(len(b.row)), np.exp(-s.params.subsample), 0.0, 0
        while cum + term > cum:
            cum, i = cum + term, i + 1
            n += u >= cum
            term *= s.params.subsample / i
    elif cut is None:
        return g, h, np.ones(len(b.row))
    elif cut[0] == "rows":
        n = _first(_lot_bits(b.row, s.seeds[k]), b.row, cut[1]).astype(float)
    else:
        _, top, other, up = cut
        is_top = _first(_goss_key(g, h, s.rank), b.row, top)
        n = np.where(is_top, 1.0, _first(_lot_bits(b.row, s.seeds[k] + 1), b.row, other))
        return g * np.where(is_top, 1.0, up) * n, h * np.where(is_top, 1.0, up) * n, n
    return g * n, h * n, n


def _first(key: np.ndarray, row: np.ndarray, last: tuple[int, int] | None) -> np.ndarray:
    """The rows up to `last` in the order (key, row id); none before nothing."""
    if last is None:
        return np.zeros(len(row), bool)
    return (key < np.uint64(last[0])) | ((key == np.uint64(last[0])) & (row <= last[1]))


def _goss_key(g: np.ndarray, h: np.ndarray, rank: str) -> np.ndarray:
    """Unsigned numbers, least for the largest gradient."""
    return ~ordered_bits(np.abs(g * h if rank == "gradient_hessian" else g))


def _count_rows(rows: int, rate: float) -> int:
    return max(1, min(rows, int(np.floor(rows * rate + 0.5))))


def _mvs_cut(data: "_Data", s: _State, k: int) -> tuple:
    """The size mu at which the rows' chances min(1, size / mu) sum to subsample * n, and the regulariser. Sizes are
    counted in cells of a sixteenth of an octave, so the number drawn is right to within the cell that holds mu."""
    shared, c = data.blocks.sparkSession.sparkContext.broadcast(s), k % s.width

    def grads(b: Block) -> np.ndarray:
        st = shared.value
        return _gradients(st.loss, _raw(st, b), b.y, b.w, c)[0]

    def total(sums, b: Block) -> None:
        sums[0][0] += np.abs(grads(b)).sum()

    reg = s.params.mvs_reg if s.params.mvs_reg is not None else float((summed(data.blocks, data.tasks, [1], total)[0][0] / max(1, data.rows)) ** 2)
    cells = 1 << 16

    def sizes(sums, b: Block) -> None:
        x = np.sqrt(grads(b) ** 2 + reg)
        at = (ordered_bits(x) >> np.uint64(48)).astype(np.int64)
        sums[0] += np.bincount(at, minlength=cells)
        sums[1] += np.bincount(at, x, cells)

    n, x = summed(data.blocks, data.tasks, [cells, cells], sizes)
    shared.destroy()
    want, over = s.params.subsample * data.rows, np.append(np.cumsum(n[::-1])[::-1], 0)
    below = np.concatenate([[0.0], np.cumsum(x)])
    fits = below[:-1] / np.maximum(want - over[:-1], 1e-300)  # if all sizes from a cell on have chance 1
    ok = np.flatnonzero((n > 0) & (want > over[:-1]))
    mu = 0.0
    for i in ok:
        if fits[i] <= (x[i] / n[i]) or i == ok[-1]:
            mu = max(fits[i], 0.0) if fits[i] <= (x[i] / n[i]) else below[-1] / max(want, 1e-300)
            break
    return "mvs", float(mu), reg


def _cut(data: "_Data", s: _State, k: int) -> tuple | None:
    """Exactly round(n * subsample) rows without replacement: the first by lot."""
    if s.params.grow_policy == "symmetric" and s.params.bootstrap_type != "none":
        return _mvs_cut(data, s, k) if s.params.bootstrap_type == "mvs" else None
    if s.params.bootstrap or s.params.subsample >= 1:
        return None
    seed = s.seeds[k]
    return "rows", kth(data.blocks, data.tasks, lambda b: _lot_bits(b.row, seed), _count_rows(data.rows, s.params.subsample))


def _goss_cut(data: "_Data", s: _State, k: int, p: "BoostParams") -> tuple:
    """round(n * top_rate) rows of the largest key, and round(n * other_rate) of the others by lot, whose gradients are scaled up."""
    n_top, n_other = int(np.floor(data.rows * p.top_rate + 0.5)), int(np.floor(data.rows * p.other_rate + 0.5))
    shared, c, rank, seed = data.blocks.sparkSession.sparkContext.broadcast(s), k % s.width, p.goss_rank, s.seeds[k]

    def key(b: Block) -> np.ndarray:
        st = shared.value
        g, h = _gradients(st.loss, _raw(st, b), b.y, b.w, c)
        return _goss_key(g, h, rank)

    top = kth(data.blocks, data.tasks, key, n_top) if n_top else None
    rest = lambda b: np.ma.masked_array(_lot_bits(b.row, seed + 1), mask=_first(key(b), b.row, top))
    other = kth(data.blocks, data.tasks, rest, min(n_other, data.rows - n_top)) if min(n_other, data.rows - n_top) > 0 else None
    shared.destroy()
    return "goss", top, other, (1 - p.top_rate) / p.other_rate


def _histograms(data: "_Data", state: _State, n_features: int) -> dict[tuple[int, int], np.ndarray]:
    """(tree, slot) -> bins x (g, h, n), one job for all."""
    shared = data.blocks.sparkSession.sparkContext.broadcast(state)
    total = int(state.offsets[-1])
    parts = [(k, node) for k, w in enumerate(state.wanted) for node in w]

    def add(sums, b: Block) -> None:
        s = shared.value
        raw, at = None if s.forest else _raw(s, b), 0
        for k, (tree, want) in enumerate(zip(s.trees, s.wanted)):
            if not want:
                continue
            g, h = (-b.w * b.y, b.w) if s.forest else _gradients(s.loss, raw, b.y, b.w, k % s.width)
            g, h, n = _sampled(s, k, b, g, h)
            slot_of = np.full(len(tree.feature), -1)
            for node, slot in want.items():
                slot_of[node] = slot
            slot = slot_of[tree.leaves(b.bins)]
            use = np.flatnonzero((slot >= 0) & (n > 0))
            slot, g, h, n, plain = slot[use], g[use], h[use], n[use], bool((n == 1).all())
            here = np.zeros((len(want), total, 3))
            for f in range(n_features):
                a, z = int(s.offsets[f]), int(s.offsets[f + 1])
                cell, size = slot * (z - a) + b.bins[use, f], len(want) * (z - a)
                for j, v in enumerate((g, h, None if plain else n)):
                    here[:, a:z, j] = np.bincount(cell, v, size).reshape(len(want), z - a)
            for slot_ in range(len(want)):
                sums[at + slot_] += here[slot_].ravel()
            at += len(want)

    found = summed(data.blocks, data.tasks, [total * 3] * len(parts), add)
    shared.destroy()
    return {key: a.reshape(total, 3) for key, a in zip(parts, found)}


@dataclass(order=True)
class _Split:
    neg_gain: float
    feature: int
    nth: int
    threshold: int = field(compare=False, default=0)
    missing_left: bool = field(compare=False, default=True)
    cats: list[int] | None = field(compare=False, default=None)
    sides: tuple = field(compare=False, default=())


def _value(g, h, p: SplitParams, extra: float = 0.0):
    t = np.sign(g) * np.maximum(np.abs(g) - p.reg_alpha, 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        if p.max_delta_step:
            w = np.clip(-t / (h + p.reg_lambda + extra), -p.max_delta_step, p.max_delta_step)
            return -(2 * g * w + (h + p.reg_lambda + extra) * w * w + 2 * p.reg_alpha * np.abs(w))
        return np.where(h + p.reg_lambda + extra > 0, t * t / (h + p.reg_lambda + extra), 0.0)


def weight(g: float, h: float, p: SplitParams) -> float:
    w = -np.sign(g) * max(abs(g) - p.reg_alpha, 0.0) / (h + p.reg_lambda) if h + p.reg_lambda > 0 else 0.0
    return float(np.clip(w, -p.max_delta_step, p.max_delta_step) if p.max_delta_step else w)


def best_split(hist: np.ndarray, offsets: np.ndarray, kinds: list[str], params: TreeParams, features: list[int] | None = None) -> _Split | None:
    """The best split of one node from its histogram; the first of equal candidates."""
    p, found = params.split, None
    for f in range(len(kinds)) if features is None else features:
        a = hist[offsets[f] : offsets[f + 1]]
        total = a.sum(axis=0)
        miss = a[0]
        if kinds[f] == "categorical" and params.cat_split == "optimal":
            cand = _categorical(a, total, f, params)
            if cand and (found is None or cand < found):
                found = cand
            continue
        run = np.cumsum(a, axis=0)[:-1]
        ways = [(run[:1], np.array([0]), np.array([True]))]
        if len(run) > 1:
            at = np.arange(1, len(run))
            if miss[2] > 0:
                ways += [(run[1:], at, np.ones(len(at), bool)), (run[1:] - miss, at, np.zeros(len(at), bool))]
            else:
                ways.append((run[1:], at, run[1:, 2] >= total[2] - run[1:, 2]))
        left, thr, ml = (np.concatenate(x) for x in zip(*ways))
        right = total - left
        ok = (left[:, 2] >= p.min_child_samples) & (right[:, 2] >= p.min_child_samples) & (left[:, 1] >= p.min_child_weight) & (right[:, 1] >= p.min_child_weight)
        gain = np.where(ok, _value(left[:, 0], left[:, 1], p) + _value(right[:, 0], right[:, 1], p) - _value(total[0], total[1], p) - p.min_split_gain, -np.inf)
        if not len(gain):
            continue
        i = int(np.argmax(np.where(np.isfinite(gain), np.round(gain, 9), gain)))
        if gain[i] > 1e-9:
            cand = _Split(-round(float(gain[i]), 9), f, i, int(thr[i]), bool(ml[i]), None, (left[i], right[i]))
            if found is None or cand < found:
                found = cand
    return found


def _categorical(a: np.ndarray, total: np.ndarray, f: int, params: TreeParams) -> _Split | None:
    p = params.split
    levels = [(i, a[i, 2], a[i, 0], a[i, 1]) for i in range(1, len(a)) if a[i, 2] > 0]
    if len(levels) + (a[0, 2] > 0) <= params.max_cat_to_onehot:
        sets = [([i], np.array([g, h, n])) for i, n, g, h in levels]
        best = None
        for cats, left in sets:
            right = total - left
            if min(left[2], right[2]) < p.min_child_samples or min(left[1], right[1]) < p.min_child_weight:
                continue
            gain = float(_value(left[0], left[1], p) + _value(right[0], right[1], p) - _value(total[0], total[1], p) - p.min_split_gain)
            if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                best = gain, cats
    else:
        best = category_set(levels, (total[2], total[0], total[1]), p, params.cat_smooth, params.cat_l2, params.max_cat_threshold, params.min_data_per_group)
    if not best:
        return None
    left = a[best[1]].sum(axis=0)
    return _Split(-round(best[0], 9), f, 0, 0, False, best[1], (left, total - left))


def _chosen(n: int, rate: float, seed: int) -> list[int]:
    """max(1, floor(n * rate)) features by lot."""
    k = max(1, int(n * rate))
    return sorted(range(n)) if k >= n else sorted(np.argsort(_lot(np.arange(n), seed), kind="stable")[:k].tolist())


def _apply_split(t: Tree, s: _Split, node: int, p: SplitParams, lr: float) -> list[int]:
    t.feature[node], t.threshold[node], t.missing_left[node], t.cats[node], t.gain[node] = s.feature, s.threshold, s.missing_left, s.cats, -s.neg_gain + p.min_split_gain
    kids = [t.add(lr * weight(x[0], x[1], p), float(x[1]), float(x[2])) for x in s.sides]
    t.left[node], t.right[node] = kids
    return kids


def grow(data: "_Data", state: _State, schema: BinSchema, ahead: int = 8) -> list[Tree]:
    """Grows all of state.trees together: a job for each level. Leaf-wise a job counts the children of the next best leaf and
    of the `ahead` best beside it, as they are likely to be split next; which leaf is split is decided one by one."""
    params, p = state.params, state.params.split
    kinds = [f.kind for f in schema.features]
    n_f, off = len(kinds), state.offsets
    hists: list[dict[int, np.ndarray]] = [{} for _ in state.trees]
    known: list[dict[int, np.ndarray]] = [{} for _ in state.trees]  # node -> the histogram of its smaller child to be
    depth: list[dict[int, int]] = [{0: 0} for _ in state.trees]
    lr = 1.0 if state.forest else p.learning_rate
    leafwise = params.grow_policy == "lossguide"
    for t in state.trees:
        t.add(0.0, 0.0, 0.0)
    state.wanted = [{0: 0} for _ in state.trees]
    for (k, node), h in _histograms(data, state, n_f).items():
        hists[k][node] = h
        s = h[: off[1]].sum(axis=0)
        t = state.trees[k]
        t.value[0], t.hess[0], t.count[0] = lr * weight(s[0], s[1], p), float(s[1]), float(s[2])
    queue: list[list[tuple[_Split, int]]] = [[] for _ in state.trees]
    leaves = [1] * len(state.trees)
    tree_features = [_chosen(n_f, params.colsample_bytree, state.seeds[k] + 11) for k in range(len(state.trees))]

    def consider(k: int, node: int) -> None:
        if params.max_depth and depth[k][node] >= params.max_depth:
            return
        own = tree_features[k]
        if params.colsample_bylevel < 1:
            own = [own[i] for i in _chosen(len(own), params.colsample_bylevel, state.seeds[k] * 31 + 17 * depth[k][node] + 5)]
        if params.colsample_bynode < 1:
            own = [own[i] for i in _chosen(len(own), params.colsample_bynode, state.seeds[k] * 1_000_003 + node)]
        s = best_split(hists[k][node], off, kinds, params, own)
        if s and min(x[2] for x in s.sides) > 0:  # a split that moves no rows is none
            heapq.heappush(queue[k], (s, node)) if leafwise else queue[k].append((s, node))

    def counted(k: int, node: int) -> bool:
        return not params.max_depth or depth[k][node] + 1 < params.max_depth

    def small_side(s: _Split) -> int:
        return 0 if s.sides[0][2] <= s.sides[1][2] else 1

    def count(plans: list[list[tuple[_Split, int]]]) -> None:
        """The smaller children of splits that aren't made yet."""
        made, nodes = [], []
        for t, plan in zip(state.trees, plans):
            own = Tree(*(list(getattr(t, f)) for f in ("feature", "threshold", "missing_left", "cats", "left", "right", "value", "gain", "hess", "count")))
            nodes.append({_apply_split(own, s, node, p, lr)[small_side(s)]: node for s, node in plan})
            made.append(own)
        trees, state.trees, state.wanted = state.trees, made, [{child: i for i, child in enumerate(n)} for n in nodes]
        for (k, child), h in _histograms(data, state, n_f).items():
            known[k][nodes[k][child]] = h
        state.trees = trees

    for k in range(len(state.trees)):
        consider(k, 0)
    while any(queue):
        plans: list[list[tuple[_Split, int]]] = []
        for k in range(len(state.trees)):
            room = params.max_leaves - leaves[k] if params.max_leaves else len(queue[k])
            if leafwise and (room <= 0 or not queue[k] or queue[k][0][1] in known[k] or not counted(k, queue[k][0][1])):
                plans.append([])
                continue
            next_ = heapq.nsmallest(min(room, ahead), queue[k]) if leafwise else queue[k][: max(0, room)]
            plans.append([(s, node) for s, node in next_ if node not in known[k] and counted(k, node)])
        if any(plans):
            count(plans)
        for k, t in enumerate(state.trees):
            for _ in range(min(1, len(queue[k])) if leafwise else len(queue[k])):
                s, node = heapq.heappop(queue[k]) if leafwise else queue[k].pop(0)
                if params.max_leaves and leaves[k] + 1 > params.max_leaves:
                    continue
                leaves[k] += 1
                kids = _apply_split(t, s, node, p, lr)
                depth[k] |= {c: depth[k][node] + 1 for c in kids}
                parent = hists[k].pop(node)
                if node in known[k]:
                    small = known[k].pop(node)
                    side = small_side(s)
                    hists[k][kids[side]], hists[k][kids[1 - side]] = small, parent - small
                    consider(k, kids[0])
                    consider(k, kids[1])
    return state.trees


def _symmetric_scores(left: np.ndarray, right: np.ndarray, kind: str, reg: float) -> np.ndarray:
    """The score of each threshold, summed over leaves; -inf where no leaf has rows on both sides. left, right: leaves x thresholds x (g, h, n)."""
    if kind == "gain":
        s = sum(x[:, :, 0] ** 2 / (x[:, :, 1] + reg + 1e-300) for x in (left, right)).sum(axis=0)
    else:
        v = [np.where(x[:, :, 2] > 0, x[:, :, 0] / (x[:, :, 2] + reg), 0.0) for x in (left, right)]
        s = sum(v[i] * x[:, :, 0] for i, x in enumerate((left, right))).sum(axis=0)
        if kind == "cosine":
            s = s / np.sqrt(sum(v[i] ** 2 * x[:, :, 2] for i, x in enumerate((left, right))).sum(axis=0) + 1e-100)
    return np.where(((left[:, :, 2] > 0) & (right[:, :, 2] > 0)).any(axis=0), np.round(s, 9), -np.inf)


def _leaf_steps(data: "_Data", state: _State, schema: BinSchema, p: SplitParams, steps: int) -> None:
    """Leaf values from all rows, sampled or not, by Newton steps: one job each. The first step's sums are also what leaves weigh."""
    places = [[i for i, f in enumerate(t.feature) if f < 0] for t in state.trees]
    values = [np.zeros(len(t.feature)) for t in state.trees]
    for step in range(steps):
        shared = data.blocks.sparkSession.sparkContext.broadcast((state, values))

        def add(sums, b: Block) -> None:
            s, values_ = shared.value  # noqa: B023
            leaf = [t.leaves(b.bins) for t in s.trees]
            raw = _raw(s, b) + np.column_stack([v[x] for v, x in zip(values_, leaf)])
            for k, t in enumerate(s.trees):
                for j, v in enumerate((*_gradients(s.loss, raw, b.y, b.w, k % s.width), None)):
                    sums[k][j :: 3] += np.bincount(leaf[k], v, len(t.feature))

        found = summed(data.blocks, data.tasks, [3 * len(t.feature) for t in state.trees], add)
        shared.destroy()
        for k, t in enumerate(state.trees):
            g, h, n = found[k].reshape(-1, 3).T
            for i in places[k]:
                values[k][i] += weight(g[i], h[i], p)
                if not step:
                    t.hess[i], t.count[i] = float(h[i]), float(n[i])
    for k, t in enumerate(state.trees):
        for i in places[k]:
            t.value[i] = p.learning_rate * float(values[k][i])


def grow_symmetric(data: "_Data", state: _State, schema: BinSchema, used: set[int] | None = None, turn: int = 0) -> list[Tree]:
    """One test for all leaves of a level; scores are summed over leaves.

    Of each split leaf the smaller side is counted. Sampling and noise only choose tests; leaf values come from all rows.
    used: features of earlier trees, for model_size_reg.
    """
    params = state.params
    n_f, off = len(schema.features), state.offsets
    mean_w = data.weight / max(1, data.rows)
    p = replace(params.split, reg_lambda=params.split.reg_lambda * mean_w)
    used = set() if used is None else used
    tables = {f: len(x.levels) for f, x in enumerate(schema.features) if x.kind == "target"}
    most = max(tables.values(), default=1)
    noise = 0.0
    if params.random_strength:
        left_over = np.exp(np.log(max(2, data.rows)) - turn * params.split.learning_rate)
        noise = params.random_strength * left_over / (1 + left_over)
    for t in state.trees:
        t.add(0.0, 0.0, 0.0)
    level = [[0] for _ in state.trees]
    hists: list[dict[int, np.ndarray]] = [{} for _ in state.trees]
    alive = [True] * len(state.trees)
    state.wanted = [{0: 0} for _ in state.trees]
    sizes = [1.0] * len(state.trees)
    if noise:
        shared = data.blocks.sparkSession.sparkContext.broadcast(state)

        def squares(sums, b: Block) -> None:
            s = shared.value
            raw = _raw(s, b)
            for k in range(len(s.trees)):
                sums[0][k] += float((_gradients(s.loss, raw, b.y, b.w, k % s.width)[0] ** 2).sum())

        sizes = np.sqrt(summed(data.blocks, data.tasks, [len(state.trees)], squares)[0] / max(1, data.rows)).tolist()
        shared.destroy()
    for deep in range(params.max_depth):
        if not any(state.wanted):
            break
        for (k, node), h in _histograms(data, state, n_f).items():
            hists[k][node] = h
        for k, t in enumerate(state.trees):
            if not alive[k]:
                continue
            for node in level[k]:  # the larger sides
                if node not in hists[k]:
                    up = next(i for i in hists[k] if node in (t.left[i], t.right[i]))
                    hists[k][node] = hists[k][up] - hists[k][t.left[up] if t.right[up] == node else t.right[up]]
            hists[k] = {n: hists[k][n] for n in level[k]}
            hs = np.stack([hists[k][n] for n in level[k]])
            draw = np.random.default_rng([state.seeds[k], deep, 77]).standard_normal if noise else None
            best = None
            for f in range(n_f):
                a = hs[:, off[f] : off[f + 1]]
                left = np.cumsum(a, axis=1)[:, :-1]
                right = a.sum(axis=1, keepdims=True) - left
                if not left.shape[1]:
                    continue
                s = _symmetric_scores(left, right, params.symmetric_score, p.reg_lambda)
                if not np.isfinite(s).any():
                    continue
                i = int(np.argmax(s + noise * sizes[k] * draw(len(s)) if noise else s))
                own = s[i] * ((1 + tables[f] / most) ** -params.model_size_reg if f in tables and f not in used else 1.0)
                rival = own + noise * sizes[k] * float(draw(1)[0]) if noise else own
                if best is None or rival > best[0]:
                    best = rival, f, i, left[:, i], right[:, i]
            if best is None:
                alive[k] = False
                continue
            used.add(best[1])
            nxt, want = [], {}
            for j, node in enumerate(level[k]):
                t.feature[node], t.threshold[node], t.missing_left[node] = best[1], best[2], True
                t.gain[node] = float(_value(best[3][j, 0], best[3][j, 1], p) + _value(best[4][j, 0], best[4][j, 1], p))
                kids = [t.add(p.learning_rate * weight(x[0], x[1], p), float(x[1]), float(x[2])) for x in (best[3][j], best[4][j])]
                t.left[node], t.right[node] = kids
                nxt += kids
                want[kids[0] if best[3][j][2] <= best[4][j][2] else kids[1]] = len(want)
            level[k] = nxt
            state.wanted[k] = want if deep + 1 < params.max_depth else {}
        state.wanted = [w if ok else {} for w, ok in zip(state.wanted, alive)]
    _leaf_steps(data, state, schema, p, params.leaf_estimation_iterations)
    return state.trees


@dataclass
class _Data:
    """Blocks of rows, how many tasks read them, how many rows there are and their total weight."""

    blocks: DataFrame
    tasks: int
    rows: int
    weight: float
    kept: DataFrame | None = None  # the written table that the blocks came from

    @staticmethod
    def of(prepared: DataFrame, width: int) -> "_Data":
        blocks = packed(prepared, width).persist()
        sizes = rows_of(blocks, "n long, w double", lambda b: {"n": np.array([len(b.row)]), "w": np.array([b.w.sum()])}).agg(F.sum("n").alias("n"), F.sum("w").alias("w")).first()
        return _Data(blocks, blocks.rdd.getNumPartitions(), sizes["n"] or 0, float(sizes["w"] or 0.0))

    def stored(self, model: Model, since: int) -> "_Data":
        """The same with trees from `since` on in the raw scores, written anew."""
        shared, width = self.blocks.sparkSession.sparkContext.broadcast(model.trees[since:]), model.width

        kept = written(with_raw(self.blocks, lambda b: _advanced(b, shared.value, width)), "rounds")
        blocks = kept.persist()
        shared.destroy()
        tasks = blocks.rdd.getNumPartitions()
        self.free()
        return _Data(blocks, tasks, self.rows, self.weight, kept)

    def free(self) -> None:
        self.blocks.unpersist()
        if self.kept is not None:
            dropped(self.kept)


def prepare(df: DataFrame, schema: BinSchema, y: str, w: str | None, row: str, base: list[float], init: list[str] | None = None) -> DataFrame:
    """row, y, w, a raw score for each class, and bins: what every job of a fit reads."""
    b = df.withColumns({f"__b_{f.name}": column_of(f) for f in schema.features if f"__b_{f.name}" not in df.columns})
    raws = [F.lit(float(x)).alias(f"__raw{i}") for i, x in enumerate(base)] if not init else [F.col(c).cast("double").alias(f"__raw{i}") for i, c in enumerate(init)]
    return b.select(F.col(row).cast("long").alias("__row"), F.col(y).cast("double").alias("__y"), (F.lit(1.0) if w is None else F.col(w).cast("double")).alias("__w"), *raws, *(F.col(f"`__b_{f.name}`").cast("int").alias(f"__b{i}") for i, f in enumerate(schema.features)))


def with_targets(df: DataFrame, schema: BinSchema, y: str, row: str, params: TreeParams) -> tuple[DataFrame, BinSchema]:
    """Replaces wide categories by their target statistics: three priors and a counter each, and of pairs if asked for.

    Training rows get buckets from the rows before them (row order), the schema keeps what all rows give.
    """
    from ..operators.targets import before_counts, bucket, ctr_counter, ctr_final

    wide = [f for f in schema.features if f.kind == "categorical" and len(f.levels) > params.one_hot_max_size]
    kept = [f for f in schema.features if f.kind != "categorical" or 1 < len(f.levels) <= params.one_hot_max_size]
    sources = [[f.name] for f in wide]
    if params.max_ctr_complexity > 1:
        sources += [[a.name, b.name] for i, a in enumerate(wide) for b in wide[i + 1 :]]
    spark = df.sparkSession
    for source in sources:
        name = "+".join(source)
        df = before_counts(df.withColumn("__key", key_of(source)), ["__key"], y, row)
        known = df.select("__key", y)
        for prior in (0.0, 0.5, 1.0):
            f32 = lambda x: F.lit(float(x)).cast("float")
            value = (F.col("__pos").cast("float") + f32(prior)).cast("float") / (F.col("__n").cast("float") + f32(1))
            df = df.withColumn(f"__b_{name}:{prior:g}", F.when(F.col("__key").isNull(), 0).otherwise(bucket(value) + 1))
            final = ctr_final(known, "__key", y, prior).where("__key IS NOT NULL").collect()
            unseen = int(min(15, int(np.float32(prior) * np.float32(15))))
            kept.append(Feature(f"{name}:{prior:g}", "target", [*(float(r["bucket"]) for r in final), float(unseen)], [r["__key"] for r in final], source))
        counted = ctr_counter(known, "__key").collect()
        f = Feature(f"{name}:n", "target", [*(float(r["bucket"]) for r in counted), 0.0], [r["__key"] for r in counted], source)
        table = spark.createDataFrame([(k, int(b) + 1) for k, b in zip(f.levels, f.edges)], "__lk string, __lb int")
        df = df.join(F.broadcast(table) if len(f.levels) <= 100_000 else table, F.col("__key") == F.col("__lk"), "left").withColumn(f"__b_{f.name}", F.coalesce("__lb", F.lit(0))).drop("__lk", "__lb", "__pos", "__n", "__key")
        kept.append(f)
    return df, BinSchema(kept)


def _linear_leaves(data: "_Data", state: _State, schema: BinSchema) -> None:
    """A slope for each numeric feature on a leaf's path, from the leaf's moments: one job for all leaves of the round."""
    params, lr = state.params, state.params.split.learning_rate
    plans: list[dict[int, list[int]]] = []
    for t in state.trees:
        paths, stack = {}, [(0, [])]
        while stack:
            n, path = stack.pop()
            if t.feature[n] < 0:
                own = list(dict.fromkeys(f for f in path if schema.features[f].kind == "numeric"))[: params.lin_leaf_max_terms]
                if own:
                    paths[n] = own
                continue
            stack += [(c, [*path, t.feature[n]]) for c in (t.left[n], t.right[n])]
        plans.append(paths)

    def values(f: int) -> np.ndarray:
        e = np.array(schema.features[f].edges)
        if not len(e):
            return np.zeros(2)
        return np.concatenate([[0.0, e[0]], (e[:-1] + e[1:]) / 2, [e[-1]]])

    shared = data.blocks.sparkSession.sparkContext.broadcast((state, plans))
    keys = [(k, n) for k, plan in enumerate(plans) for n in plan]

    def add(sums, b: Block) -> None:
        s, plans_ = shared.value
        raw, at_ = _raw(s, b), 0
        for k, t in enumerate(s.trees):
            g, h = _gradients(s.loss, raw, b.y, b.w, k % s.width)
            leaf = t.leaves(b.bins)
            for n, fs in plans_[k].items():
                at = np.flatnonzero(leaf == n)
                x = np.column_stack([values(f)[b.bins[at, f]] for f in fs])
                m = (b.bins[at][:, fs] > 0).astype(float)
                hm, gm = h[at, None] * m, g[at, None] * m
                sums[at_] += np.concatenate([hm.sum(0), (hm * x).sum(0), (hm * x * x).sum(0), gm.sum(0), (gm * x).sum(0), ((hm * x).T @ (m * x)).ravel(), (hm.T @ m).ravel(), ((hm * x).T @ m).ravel(), [len(at)]])
                at_ += 1

    found = summed(data.blocks, data.tasks, [5 * len(plans[k][n]) + 3 * len(plans[k][n]) ** 2 + 1 for k, n in keys], add)
    shared.destroy()
    for (k, n), c in zip(keys, found):
        fs = plans[k][n]
        q = len(fs)
        if c[-1] <= q + 1:  # too few rows for so many slopes: the leaf stays constant
            continue
        sh, shx, shxx, sg, sgx = (c[i * q : (i + 1) * q] for i in range(5))
        xx, mm, xm = (c[5 * q + i * q * q : 5 * q + (i + 1) * q * q].reshape(q, q) for i in range(3))
        mean = np.where(sh > 0, shx / np.maximum(sh, 1e-300), 0.0)
        sd = np.sqrt(np.maximum(0, np.where(sh > 0, shxx / np.maximum(sh, 1e-300), 0.0) - mean**2))
        ok = sd > 1e-12
        if not ok.any():
            continue
        # Centred second moments over rows that have both features; missing sits at the centre.
        a = xx - xm * mean[None, :] - xm.T * mean[:, None] + mean[:, None] * mean[None, :] * mm
        g = sgx - mean * sg
        a, g, scale = a[np.ix_(ok, ok)] / np.outer(sd[ok], sd[ok]), g[ok] / sd[ok], sd[ok]
        beta = -np.linalg.solve(a + params.lin_leaf_lambda * float(sh.max()) * np.eye(len(g)), g) / scale
        if not np.isfinite(beta).all():
            continue
        used = [f for f, o in zip(fs, ok) if o]
        table = []
        for f, m in zip(used, mean[ok]):
            v = values(f) - m
            v[0] = 0.0
            table.append(v.tolist())
        state.trees[k].lin[str(n)] = [used, (lr * beta).tolist(), table]


def _offsets(schema: BinSchema) -> np.ndarray:
    return np.concatenate([[0], np.cumsum([f.n_bins for f in schema.features])])


def _renewed(data: "_Data", state: _State, loss: Loss, lr: float, weighted: bool) -> None:
    """L1 and quantile leaves take a percentile of what is left, before the tree is applied."""
    shared, t = data.blocks.sparkSession.sparkContext.broadcast(state), state.trees[0]
    places = [i for i, f in enumerate(t.feature) if f < 0]
    number = np.full(len(t.feature), -1)
    number[places] = np.arange(len(places))

    def residuals(b: Block) -> tuple[np.ndarray, np.ndarray]:
        s = shared.value
        return number[s.trees[0].leaves(b.bins)], b.y - _raw(s, b)[:, 0]

    alpha = 0.5 if loss.objective == "absolute_error" else loss.quantile_alpha
    for i, v in zip(places, group_percentiles(data.blocks, data.tasks, len(places), residuals, alpha, weighted)):
        if np.isfinite(v):
            t.value[i] = lr * float(v)
    shared.destroy()


def held_score(data: "_Data", model: Model, since: int, name: str, loss: Loss) -> float:
    """A metric over held-out rows, with trees from `since` on added to the raw scores."""
    from ..functions.metrics import metric

    shared, width, objective = data.blocks.sparkSession.sparkContext.broadcast(model.trees[since:]), model.width, model.objective

    def scored(b: Block) -> dict[str, np.ndarray]:
        raw = _advanced(b, shared.value, width)
        p = natural(objective, raw)
        return {"y": b.y, "w": b.w} | ({f"p{i}": np.ascontiguousarray(p[:, i]) for i in range(width)})

    rows = rows_of(data.blocks, "y double, w double, " + ", ".join(f"p{i} double" for i in range(width)), scored)
    if width > 1:
        rows = rows.select("w", F.col("y").cast("int").alias("y"), F.array(*(f"p{i}" for i in range(width))).alias("p0"))
    how = {"mlogloss": {"raw": False}, "pinball": {"alpha": loss.quantile_alpha}, "mphe": {"slope": loss.huber_slope}}.get(name, {})
    return metric(name, rows, "p0", "y", "w", **how).first()["value"]


def check_init(df: DataFrame, init: list[str], width: int) -> None:
    """Own starting scores: numeric, finite, one column for each output."""
    if len(init) != width:
        raise ValueError(f"{len(init)} columns of starting scores for {width} outputs")
    kinds = dict(df.dtypes)
    text = [c for c in init if kinds[c] in ("string", "boolean")]
    if text:
        raise ValueError(f"starting scores must be numbers: {', '.join(text)}")
    x = {c: F.col(c).cast("double") for c in init}
    bad = df.agg(*(F.count(F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 1)).alias(c) for c, v in x.items())).first()
    if any(bad):
        raise ValueError(f"starting scores are missing or not finite in {', '.join(c for c in init if bad[c])}")


def train(df: DataFrame, kinds: dict[str, str], y: str, params: BoostParams = BoostParams(), w: str | None = None, row: str = "row_id", valid: str | None = None, schema: BinSchema | None = None, start: Model | None = None, init: list[str] | None = None) -> Model:
    """Boosted trees. valid: a boolean column whose true rows only score rounds; start: a model to continue; init: own starting scores.

    With early stopping every round is scored by eval_metric, or the objective's own metric, and the best rounds are kept.
    """
    from ..functions.metrics import DEFAULT, HIGHER_IS_BETTER
    from ..operators.rows import check_labels

    loss = params.loss
    fit_rows = df.where(~F.col(valid)) if valid else df
    check_labels(fit_rows, y, loss.objective)
    schema = start.schema if start else schema or fit_schema(fit_rows, kinds, params.bins)
    if start:
        base = start.base
    elif init and loss.objective != "softmax":
        base = [0.0] * len(init)
    elif params.base_score is not None and loss.objective != "softmax":
        base = [float(params.base_score)]
    else:
        found = base_score(fit_rows, loss, y, w, row)
        base = [r["score"] for r in (found.orderBy("class") if loss.objective == "softmax" else found).collect()]
    if init:
        check_init(df, init, len(base) if loss.objective == "softmax" or start else 1)
        base = [0.0] * len(base)
    tree = params.tree
    if loss.objective == "poisson" and not tree.split.max_delta_step:
        tree = replace(tree, split=replace(tree.split, max_delta_step=loss.poisson_max_delta_step))
    model = Model(schema, list(start.trees) if start else [], list(base), loss.objective)
    if tree.grow_policy == "symmetric" and not start and any(f.kind == "categorical" for f in schema.features):
        fit_rows, schema = with_targets(fit_rows, schema, y, row, tree)
        model.schema = schema
    prefixes = []
    if tree.boosting_type == "ordered":
        from ..operators.targets import ordered_prefixes

        if model.width > 1 or init:
            raise ValueError("ordered boosting has one output and no starting scores")
        prefixes, fit_rows = ordered_prefixes(fit_rows.count()), numbered(fit_rows, row)
    own = [*base, *base * len(prefixes)]  # every prefix starts where the model does
    data = _Data.of(prepare(fit_rows, schema, y, w, row, own, init), len(own))
    seen = _Data.of(prepare(df.where(F.col(valid)), schema, y, w, row, base, init), model.width) if valid and params.early_stopping_rounds else None
    if seen is not None and not seen.rows:
        seen = seen.free()
    name = params.eval_metric or DEFAULT[loss.objective]
    width, stored, offsets, best, used = model.width, 0, _offsets(schema), None, set()
    for turn in range(params.n_rounds):
        state = _State(width, model.trees[stored:], [Tree.empty() for _ in range(width)], [], offsets, loss, tree, [tree.seed * 7919 + (len(model.trees) + k) * 101 for k in range(width)], False, rank=params.goss_rank)
        if params.sampling == "goss" and not (params.goss_warmup and turn < int(1 / tree.split.learning_rate)):
            state.cuts = [_goss_cut(data, state, k, params) for k in range(width)]
        elif params.sampling == "uniform":
            state.cuts = [_cut(data, state, k) for k in range(width)]
        if prefixes:
            grow_ordered(data, state, schema, prefixes)
        elif tree.grow_policy == "symmetric":
            grow_symmetric(data, state, schema, used, turn)
        else:
            grow(data, state, schema)
        if loss.objective in ("absolute_error", "quantile"):
            _renewed(data, state, loss, tree.split.learning_rate, w is not None)
        elif tree.linear_leaves:
            _linear_leaves(data, state, schema)
        model.trees += state.trees
        if len(model.trees) - stored >= params.store_every * width and turn + 1 < params.n_rounds:
            data, seen, stored = data.stored(model, stored), seen and seen.stored(model, stored), len(model.trees)
        if seen:
            s = held_score(seen, model, stored, name, loss)
            model.history.append(s)
            s = -s if name in HIGHER_IS_BETTER else s
            if best is None or s < best[0]:
                best = (s, len(model.trees))
            elif len(model.trees) - best[1] >= params.early_stopping_rounds * width:
                break
    if best:
        model.trees = model.trees[: best[1]]
    data.free()
    if seen:
        seen.free()
    return model


@dataclass(frozen=True)
class ForestParams:
    n_trees: int = 300
    max_depth: int = 0
    max_leaves: int = 1024
    min_child_samples: int = 1
    colsample_bynode: float | None = None
    subsample: float = 1.0
    bootstrap: bool = True
    seed: int = 0
    bins: BinParams = field(default_factory=BinParams)
    trees_per_job: int = 16


def train_forest(df: DataFrame, kinds: dict[str, str], y: str, params: ForestParams = ForestParams(), w: str | None = None, row: str = "row_id", classification: bool = True) -> Model:
    """A random forest: leaves are weighted means; many trees share each job. A depth of 0 has no limit but max_leaves."""
    schema = fit_schema(df, kinds, params.bins)
    n = len(kinds)
    rate = params.colsample_bynode or (max(1, int(np.sqrt(n))) / n if classification else 1 / 3)
    tree = TreeParams("depthwise", params.max_depth, params.max_leaves, SplitParams(0.0, 0.0, 0.0, params.min_child_samples, 0.0, 0.0, 1.0), params.subsample, params.bootstrap, 1.0, rate, params.seed)
    model = Model(schema, [], [0.0], "squared_error", average=True)
    data = _Data.of(prepare(df, schema, y, w, row, [0.0]), 1)
    for first in range(0, params.n_trees, params.trees_per_job):
        k = min(params.trees_per_job, params.n_trees - first)
        state = _State(1, [], [Tree.empty() for _ in range(k)], [], _offsets(schema), Loss("squared_error"), tree, [params.seed * 7919 + (first + i) * 101 + 1 for i in range(k)], True)
        state.cuts = [_cut(data, state, i) for i in range(k)]
        model.trees += grow(data, state, schema)
    data.free()
    return model
