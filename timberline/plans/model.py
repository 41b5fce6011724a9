"""Tree models: nodes, prediction in Arrow batches, storage, blends."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.binning import BinSchema, Feature


@dataclass
class Tree:
    """Nodes in arrays: feature -1 marks a leaf; cats lists bins that go left (else bin <= threshold)."""

    feature: list[int]
    threshold: list[int]
    missing_left: list[bool]
    cats: list[list[int] | None]
    left: list[int]
    right: list[int]
    value: list[float]
    gain: list[float]
    hess: list[float]
    count: list[float]
    #: Leaves that are affine: leaf -> [features, slopes, the value of each bin of each feature]; missing gives the leaf's centre, 0.
    lin: dict[str, list] = field(default_factory=dict)

    @staticmethod
    def empty() -> "Tree":
        return Tree([], [], [], [], [], [], [], [], [], [])

    def add(self, value: float, hess: float, count: float) -> int:
        for f, v in (("feature", -1), ("threshold", 0), ("missing_left", True), ("cats", None), ("left", -1), ("right", -1), ("value", value), ("gain", 0.0), ("hess", hess), ("count", count)):
            getattr(self, f).append(v)
        return len(self.feature) - 1

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row: as many vector steps as the tree is deep. A leaf leads to itself."""
        feature, own = np.array(self.feature, np.int32), np.arange(len(self.feature), dtype=np.int32)
        inner = feature >= 0
        f, left, right = (np.where(inner, x, y).astype(np.int32) for x, y in ((feature, 0), (self.left, own), (self.right, own)))
        # Where missing goes right, bin 0 wraps round to the largest number.
        off = (inner & ~np.array(self.missing_left, bool)).astype(np.uint16)
        most = np.where(inner, np.array(self.threshold, np.int32) - off, 65_535)
        sets = {i: np.array(c) for i, c in enumerate(self.cats) if c is not None}
        node, rows, depth, level = np.zeros(len(bins), np.int32), np.arange(len(bins)), 0, [0]
        while level := [c for n in level if inner[n] for c in (self.left[n], self.right[n])]:
            depth += 1
        for _ in range(depth):
            b = bins[rows, f[node]].astype(np.uint16)
            go = (b - off[node]) <= most[node]
            for i, c in sets.items():
                at = np.flatnonzero(node == i)
                if len(at):
                    go[at] = np.where(b[at] == 0, self.missing_left[i], np.isin(b[at], c))
            node = np.where(go, left[node], right[node])
        return node

    def predict(self, bins: np.ndarray) -> np.ndarray:
        leaf = self.leaves(bins)
        out = np.array(self.value)[leaf]
        for n, (features, slopes, values) in self.lin.items():
            at = np.flatnonzero(leaf == int(n))
            for f, s, v in zip(features, slopes, values):
                out[at] += s * np.array(v)[bins[at, f]]
        return out


@dataclass
class Model:
    schema: BinSchema
    trees: list[Tree]
    base: list[float]
    objective: str
    average: bool = False
    classes: list[str] = field(default_factory=list)
    history: list[float] = field(default_factory=list)

    @property
    def width(self) -> int:
        return len(self.base)

    def raw(self, bins: np.ndarray, trees: list[Tree] | None = None, base: bool = True) -> np.ndarray:
        out = np.tile(np.array(self.base if base else [0.0] * self.width), (len(bins), 1))
        trees = self.trees if trees is None else trees
        for i, t in enumerate(trees):
            out[:, i % self.width] += t.predict(bins) / (len(trees) // self.width if self.average else 1)
        return out

    def to_json(self) -> str:
        return json.dumps({"format": "timberline", "version": 1} | asdict(self))

    @staticmethod
    def from_json(text: str) -> "Model":
        d = json.loads(text)
        if not isinstance(d, dict) or d.get("format") != "timberline" or d.get("version") != 1:
            raise ValueError("not a stored model of this version")
        return Model(BinSchema([Feature(**f) for f in d["schema"]["features"]]), [Tree(**t) for t in d["trees"]], d["base"], d["objective"], d["average"], d["classes"], d["history"])

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(self.to_json(),)], "model string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Model":
        return Model.from_json(spark.read.text(path, wholetext=True).first()[0])

    def nodes(self, spark: SparkSession) -> DataFrame:
        rows = [(i, n, t.feature[n] < 0, self.schema.features[t.feature[n]].name if t.feature[n] >= 0 else None, t.threshold[n], t.missing_left[n], t.value[n], t.gain[n], t.hess[n], t.count[n]) for i, t in enumerate(self.trees) for n in range(len(t.feature))]
        return spark.createDataFrame(rows, "tree int, node int, is_leaf boolean, feature string, threshold int, missing_left boolean, value double, gain double, cover double, n double")


def stump(feature: str, edge: float, left: float, right: float, h_left: float, h_right: float, base: float = 0.0) -> Model:
    """One split at an edge."""
    t = Tree.empty()
    for v, h in ((0.0, h_left + h_right), (left, h_left), (right, h_right)):
        t.add(v, h, h)
    t.feature[0], t.threshold[0], t.left[0], t.right[0] = 0, 1, 1, 2
    return Model(BinSchema([Feature(feature, "numeric", edges=[edge])]), [t], [base], "logistic")


def bins_of(batch, at: list[int]) -> np.ndarray:
    """The bin columns of an Arrow batch as a matrix."""
    return np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in at]).astype(np.int32) if batch.num_rows else np.zeros((0, len(at)), np.int32)


def mapped(df: DataFrame, model: Model, keep: list[str], out: list[str], run) -> DataFrame:
    """Bins features in the JVM and runs a vector function over the bins; one narrow stage, the model broadcast."""
    import pyarrow as pa

    from ..operators.binning import column_of, columns_needed

    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)
    fs = model.schema.features
    lacking = [c for c in columns_needed(model.schema) if c not in df.columns]
    if lacking:
        raise ValueError(f"no column {', '.join(lacking)}")
    cols = [column_of(f).alias(f"__b{i}") for i, f in enumerate(fs)]
    d = df.select(*keep, *cols)
    n = len(keep)

    def go(batches):
        for b in batches:
            got = run(shared.value, bins_of(b, list(range(n, n + len(fs)))))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n)), *(pa.array(got[:, i]) for i in range(len(out)))], [*keep, *out])

    schema = df.select(*keep).schema
    for o in out:
        schema = schema.add(o, "double")
    return d.mapInArrow(go, schema)


def natural(objective: str, raw: np.ndarray) -> np.ndarray:
    if objective == "logistic":
        return 1 / (1 + np.exp(-raw))
    if objective == "poisson":
        return np.exp(raw)
    if objective == "softmax":
        e = np.exp(raw - raw.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)
    return raw


def predict(df: DataFrame, model: Model, keep: list[str] | None = None, raw: bool = False) -> DataFrame:
    """keep and prediction (or prediction_<class>). Works on streams too: nothing is kept between rows."""
    out = ["prediction"] if model.width == 1 else [f"prediction_{c}" for c in (model.classes or range(model.width))]
    return mapped(df, model, df.columns if keep is None else keep, out, lambda m, b: m.raw(b) if raw or m.average else natural(m.objective, m.raw(b)))


def blend(scores: list[Column], weights: list[float]) -> Column:
    """The weighted mean; weights are normalised and must not be negative."""
    if len(scores) != len(weights) or any(w < 0 for w in weights) or not sum(weights):
        raise ValueError("weights must match the scores, not be negative and not all be zero")
    return sum((s * w for s, w in zip(scores[1:], weights[1:])), scores[0] * weights[0]) / sum(weights)
