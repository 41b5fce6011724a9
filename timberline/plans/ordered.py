"""Ordered boosting of symmetric trees: tests are scored on rows that the estimates haven't seen.

Rows have a position. For prefixes (body, tail) that double, every row before the tail has a raw score of its own, from
Newton steps over the body alone. A level's test is scored by what the body's leaf estimates do for the rows of the
tail, summed over prefixes and leaves; leaf values of the model itself come from all rows. Raw scores of the prefixes
stand beside the model's in the blocks, so a round is a job for each level, one for the prefixes' steps and one for the leaves.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.binning import BinSchema
from ..operators.order import positions, range_of
from .blocks import Block, summed
from .model import Tree


def numbered(df: DataFrame, row: str, chunks: int = 64) -> DataFrame:
    """df with its row ids replaced by positions from 0, in the order of the ids, counted range by range."""
    cuts = sorted(set(df.approxQuantile(row, [i / chunks for i in range(1, chunks)], 0.01)))
    return positions(df, [range_of(F.col(row), cuts)], [row], "__pos").withColumn(row, F.col("__pos").cast("long")).drop("__pos")


def scores(body: np.ndarray, tail: np.ndarray, reg: list[float], kind: str) -> np.ndarray:
    """The score of each threshold of one feature; -inf where no leaf has rows on both sides.

    body, tail: prefixes x leaves x bins x (g, n); reg: the penalty of each prefix.
    """
    run = lambda x: np.cumsum(x, axis=2)[:, :, :-1]
    lb, lt = run(body), run(tail)
    rb, rt = body.sum(2, keepdims=True) - lb, tail.sum(2, keepdims=True) - lt
    lam = np.array(reg)[:, None, None]
    num, den = 0.0, 1e-100
    for b, t in ((lb, lt), (rb, rt)):
        est = np.where(b[..., 1] > 0, b[..., 0] / np.maximum(b[..., 1] + lam, 1e-300), 0.0)
        num = num + (est * t[..., 0]).sum((0, 1))
        den = den + (est * est * t[..., 1]).sum((0, 1))
    both = ((lb[..., 1] + lt[..., 1] > 0) & (rb[..., 1] + rt[..., 1] > 0)).any((0, 1))
    return np.where(both, np.round(num / np.sqrt(den) if kind == "cosine" else num, 9), -np.inf)


def grow_ordered(data, state, schema: BinSchema, prefixes: list[tuple[int, int]]) -> list[Tree]:
    """One tree; its `prefix` says, for each prefix, the tail and what each leaf adds to the scores before it."""
    from .boost import _leaf_steps, _raw, _value, weight  # boost imports this module

    params, off, total, m = state.params, state.offsets, int(state.offsets[-1]), len(prefixes)
    spark, t = data.blocks.sparkSession, state.trees[0]
    mean_w = data.weight / max(1, data.rows)
    p = replace(params.split, reg_lambda=params.split.reg_lambda * mean_w)
    reg = [p.reg_lambda] * m
    t.add(0.0, 0.0, 0.0)
    level = [0]

    def derivatives(s, b: Block):
        """(prefix, rows before the tail, their g and h, whether they are in the body)."""
        from .boost import _gradients

        raw = _raw(s, b)
        for j, (body, tail) in enumerate(prefixes):
            at = np.flatnonzero(b.row < tail)
            if len(at):
                g, h = _gradients(s.loss, raw[at, 1 + j : 2 + j], b.y[at], b.w[at], 0)
                yield j, at, g, h, b.row[at] < body

    for _ in range(params.max_depth):
        shared, n_leaves = spark.sparkContext.broadcast((state, level)), len(level)

        def add(sums, b: Block) -> None:
            s, nodes = shared.value  # noqa: B023
            place = np.full(len(s.trees[0].feature), -1)
            place[nodes] = np.arange(len(nodes))
            leaf = place[s.trees[0].leaves(b.bins)]
            for j, at, g, _, inside in derivatives(s, b):
                here = np.zeros((2, len(nodes), total, 2))
                for k, part in enumerate((inside, ~inside)):
                    rows = at[part]
                    for f in range(len(off) - 1):
                        a, z = int(off[f]), int(off[f + 1])
                        cell = leaf[rows] * (z - a) + b.bins[rows, f]
                        for i, v in enumerate((g[part], None)):
                            here[k, :, a:z, i] = np.bincount(cell, v, len(nodes) * (z - a)).reshape(len(nodes), z - a)
                sums[j] += here.ravel()

        found = np.stack([x.reshape(2, n_leaves, total, 2) for x in summed(data.blocks, data.tasks, [2 * n_leaves * total * 2] * m, add)])
        shared.destroy()
        best = None
        for f in range(len(off) - 1):
            part = found[:, :, :, off[f] : off[f + 1]]
            if part.shape[3] > 1:
                s = scores(part[:, 0], part[:, 1], reg, params.symmetric_score)
                i = int(np.argmax(s))
                if np.isfinite(s[i]) and (best is None or s[i] > best[0]):
                    best = s[i], f, i
        if best is None:
            break
        level = [c for node in level for c in _split(t, node, best[1], best[2])]
    _leaf_steps(data, state, schema, p, params.leaf_estimation_iterations)
    shared = spark.sparkContext.broadcast(state)
    size = len(t.feature)

    def body_sums(sums, b: Block) -> None:
        s = shared.value
        leaf = s.trees[0].leaves(b.bins)
        for j, at, g, h, inside in derivatives(s, b):
            rows = at[inside]
            sums[j][:size] += np.bincount(leaf[rows], g[inside], size)
            sums[j][size:] += np.bincount(leaf[rows], h[inside], size)

    steps = summed(data.blocks, data.tasks, [2 * size] * m, body_sums)
    shared.destroy()
    t.prefix = [(tail, np.array([p.learning_rate * weight(g, h, p) for g, h in x.reshape(2, size).T])) for (_, tail), x in zip(prefixes, steps)]
    for node, f in enumerate(t.feature):  # inner nodes weigh what their leaves do
        if f >= 0:
            t.gain[node] = 0.0
    for node in range(size - 1, -1, -1):
        if t.feature[node] >= 0:
            a, b = t.left[node], t.right[node]
            t.hess[node], t.count[node] = t.hess[a] + t.hess[b], t.count[a] + t.count[b]
            t.gain[node] = float(_value(-t.value[a] * t.hess[a], t.hess[a], p) + _value(-t.value[b] * t.hess[b], t.hess[b], p))
    return state.trees


def _split(t: Tree, node: int, feature: int, threshold: int) -> list[int]:
    t.feature[node], t.threshold[node], t.missing_left[node] = feature, threshold, True
    t.left[node], t.right[node] = t.add(0.0, 0.0, 0.0), t.add(0.0, 0.0, 0.0)
    return [t.left[node], t.right[node]]
