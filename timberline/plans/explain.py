"""Importance and Shapley values."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .model import Model, Tree, mapped


def importance(nodes: DataFrame) -> DataFrame:
    """feature, gain, cover, splits over inner nodes."""
    return nodes.where(~F.col("is_leaf")).groupBy("feature").agg(F.sum("gain").alias("gain"), F.sum("cover").alias("cover"), F.count("*").alias("splits"))


def _leaf_paths(t: Tree, cover: list[float]):
    """For each leaf: its value and, by feature, the share of cover that follows the path and the nodes that must agree."""
    out, stack = [], [(0, [])]
    while stack:
        n, path = stack.pop()
        if t.feature[n] < 0:
            out.append((t.value[n], path))
            continue
        for child, left in ((t.left[n], True), (t.right[n], False)):
            share = cover[child] / cover[n] if cover[n] else 0.0
            stack.append((child, [*path, (n, left, share)]))
    return out


def _weights(k: int) -> np.ndarray:
    """|S|! (k - |S| - 1)! / k! for each size of S."""
    from math import factorial

    return np.array([factorial(s) * factorial(k - s - 1) / factorial(k) for s in range(k)])


def tree_shap_values(t: Tree, bins: np.ndarray, cover: str = "hess") -> tuple[np.ndarray, float]:
    """Path-dependent values of every row and the expected value, leaf by leaf.

    On a leaf's path each feature either agrees (1) or is left to cover (its share), so a leaf's part is a product over
    features, and Shapley weights sum over subset sizes by a polynomial.
    """
    c = getattr(t, cover)
    go = {}
    for n, f in enumerate(t.feature):
        if f >= 0:
            b = bins[:, f]
            inner = np.isin(b, t.cats[n]) if t.cats[n] is not None else b <= t.threshold[n]
            go[n] = np.where(b == 0, t.missing_left[n], inner)
    phi, bias = np.zeros(bins.shape), 0.0
    for value, path in _leaf_paths(t, c):
        feats = sorted({t.feature[n] for n, _, _ in path})
        agree = np.ones((len(feats), len(bins)))
        share = np.ones(len(feats))
        for n, left, s in path:
            i = feats.index(t.feature[n])
            agree[i] *= go[n] == left
            share[i] *= s
        bias += value * share.prod()
        k = len(feats)
        if not k:
            continue
        w = _weights(k)
        for i in range(k):
            poly = np.zeros((k, len(bins)))  # coefficient s: sum over subsets of size s of the others
            poly[0] = 1.0
            for j in range(k):
                if j != i:
                    poly[1:] = poly[1:] * share[j] + poly[:-1] * agree[j]
                    poly[0] *= share[j]
            phi[:, feats[i]] += value * (agree[i] - share[i]) * (w[:, None] * poly).sum(axis=0)
    return phi, bias


def tree_shap(df: DataFrame, model: Model, keep: list[str], cover: str = "hess", raw: bool = False) -> DataFrame:
    """keep, shap_<feature>.., shap_bias: they add up to the raw score, which raw adds as __raw0.. With classes each name has the class before it."""
    names = [f.name for f in model.schema.features]
    labels = [""] if model.width == 1 else [f"{c}_" for c in (model.classes or range(model.width))]
    out = [f"shap_{p}{x}" for p in labels for x in (*names, "bias")] + [f"__raw{i}" for i in range(model.width) if raw]

    def run(m: Model, bins: np.ndarray) -> np.ndarray:
        parts = []
        for c in range(m.width):
            phi, bias = np.zeros(bins.shape), m.base[c]
            own = m.trees[c :: m.width]
            for t in own:
                p, b = tree_shap_values(t, bins, cover)
                scale = 1 / len(own) if m.average else 1
                phi, bias = phi + p * scale, bias + b * scale
            parts.append(np.column_stack([phi, np.full(len(bins), bias)]))
        return np.column_stack([*parts, m.raw(bins)] if raw else parts)

    return mapped(df, model, keep, out, run)


def linear_shap(df: DataFrame, coefficients: dict[str, float], stats: dict[str, tuple[float, float]]) -> DataFrame:
    """df with shap_<feature>: coefficient times standardised value."""
    return df.withColumns({f"shap_{c}": w * F.coalesce(F.try_divide(F.col(c) - stats[c][0], F.lit(stats[c][1])), F.lit(0.0)) for c, w in coefficients.items()})


def linear_model_shap(df: DataFrame, model, keep: list[str]) -> DataFrame:
    """keep, shap_<feature>.., shap_bias: a feature's columns together; of many classes shap_<class>_<feature>."""
    from .linear import standard

    xs, outs = standard(model), []
    of = [f for f, _ in model.design.columns] if model.design is not None else list(model.features)
    many = len(model.intercepts) > 1
    for k, (coefs, bias) in enumerate(zip(model.coefficients, model.intercepts)):
        head = f"shap_{model.classes[k] if model.classes else k}_" if many else "shap_"
        for name in dict.fromkeys(of):
            outs.append(sum((x * float(c) for x, c, o in zip(xs, coefs, of) if o == name), F.lit(0.0)).alias(head + name))
        outs.append(F.lit(float(bias)).alias(head + "bias"))
    return df.select(*keep, *outs)


def check_additive(shap: DataFrame, raw: Column, columns: list[str], tolerance: float = 1e-6) -> None:
    """Refuses values that don't sum to the raw score, in shares of the largest."""
    total = sum((F.col(f"`{c}`") for c in columns), F.lit(0.0))
    r = shap.agg(F.max(F.abs(total - raw)).alias("apart"), F.max(F.abs(raw)).alias("size")).first()
    if r["apart"] is not None and r["apart"] > tolerance * max(1.0, r["size"]):
        raise ValueError(f"the values miss the raw score by {r['apart']}")


def write_shap(shap: DataFrame, path: str, id_col: str | None = None, digits: int = 8) -> None:
    """A CSV folder: the id if any, then every value with eight decimals."""
    values = [c for c in shap.columns if c.startswith("shap_")]
    shap.select(*([id_col] if id_col else []), *(F.format_string(f"%.{digits}f", F.col(f"`{c}`")).alias(c) for c in values)).write.mode("overwrite").csv(path, header=True)


def top(table: DataFrame, value: str, n: int | None = None) -> DataFrame:
    """The n largest rows by a value, ties by the first column; all without n."""
    ordered = table.orderBy(F.desc(value), table.columns[0])
    return ordered if n is None else ordered.limit(n)


def mean_abs(shap: DataFrame, columns: list[str]) -> DataFrame:
    return shap.agg(*(F.avg(F.abs(c)).alias(c) for c in columns))
