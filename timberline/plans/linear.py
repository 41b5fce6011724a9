"""Linear and logistic models: the design of columns, moments, normal equations and MLlib's L-BFGS / OWL-QN with the penalty in
this library's terms.

A design turns features into columns: a number into the mean of its bin (missing: the mean of all), a category into one
column for each level (missing or unseen: none of them).

The objective is (1/n) sum loss + (lambda/2n) |w|^2 + (alpha/n) |w|_1 on standardised columns, the intercept free.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.binning import BinParams, BinSchema, column_of, fit_schema, level_of

#: The most columns that a design may have.
MAX_COLUMNS = 1 << 16


@dataclass(frozen=True)
class LinearParams:
    objective: str = "logistic"
    reg_lambda: float = 1.0
    reg_alpha: float = 0.0
    max_iter: int = 300
    tol: float = 1e-7
    standardize: bool = True
    scale_pos_weight: float = 1.0

    def __post_init__(self):
        if self.objective not in ("logistic", "squared_error", "softmax"):
            raise ValueError("a linear model is logistic, squared_error or softmax")
        if self.reg_lambda < 0 or self.reg_alpha < 0:
            raise ValueError("penalties must not be negative")


@dataclass
class Design:
    """Columns, as (feature, level or None), of binned features. means: of a numeric feature the value of each bin."""

    schema: BinSchema
    means: dict[str, list[float]]

    @property
    def columns(self) -> list[tuple[str, str | None]]:
        out: list[tuple[str, str | None]] = []
        for f in self.schema.features:
            out += [(f.name, None)] if f.kind == "numeric" else [(f.name, v) for v in f.levels]
        return out

    @property
    def names(self) -> list[str]:
        return [f if v is None else f"{f}={v}" for f, v in self.columns]

    def values(self) -> list[Column]:
        """The columns as expressions of the features."""
        out: list[Column] = []
        for f in self.schema.features:
            if f.kind == "numeric":
                out.append(F.element_at(F.array(*map(F.lit, self.means[f.name])), column_of(f) + 1))
            else:
                own = level_of(F.col(f.name), f.levels)
                out += [F.when(own == i + 1, 1.0).otherwise(0.0) for i in range(len(f.levels))]
        return out

    def applied(self, df: DataFrame) -> DataFrame:
        lacking = [f.name for f in self.schema.features if f.name not in df.columns]
        if lacking:
            raise ValueError(f"no column {', '.join(lacking)}")
        return df.withColumns({f"__d{i}": c for i, c in enumerate(self.values())})


@dataclass
class LinearModel:
    features: list[str]
    coefficients: list[list[float]]
    intercepts: list[float]
    stats: dict[str, tuple[float, float]]
    objective: str
    stalled: bool = False
    kinds: dict[str, str] = field(default_factory=dict)
    design: Design | None = None  # features are then its columns' names
    classes: list[str] = field(default_factory=list)

    @property
    def inputs(self) -> list[str]:
        return list(self.features) if self.design is None else [f.name for f in self.design.schema.features]


def design(df: DataFrame, kinds: dict[str, str], bins: BinParams = BinParams(), schema: BinSchema | None = None) -> Design:
    """Bins and their means: two scans, whatever the number of features. Features that tell nothing have no column."""
    schema = schema or fit_schema(df, kinds, bins)
    schema = BinSchema([f for f in schema.features if f.n_bins > 1])
    numeric = [f for f in schema.features if f.kind == "numeric"]
    means: dict[str, list[float]] = {}
    if numeric:
        pairs = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), column_of(f).alias("bin"), F.col(f.name).cast("double").alias("v")) for i, f in enumerate(numeric)))).alias("x")
        found = df.select(pairs).select("x.*").where("v IS NOT NULL").groupBy("i", "bin").agg(F.avg("v").alias("m"), F.count("*").alias("n")).collect()
        for i, f in enumerate(numeric):
            own, e = {r.bin: (r.m, r.n) for r in found if r.i == i}, f.edges
            rows = sum(n for _, n in own.values())
            whole = sum(m * n for m, n in own.values()) / rows if rows else 0.0
            middle = lambda b: whole if not e else e[0] if b == 1 else e[-1] if b > len(e) else (e[b - 2] + e[b - 1]) / 2  # noqa: B023, E731
            means[f.name] = [whole, *(own[b][0] if b in own else middle(b) for b in range(1, f.n_bins))]
    out = Design(schema, means)
    if not out.columns:
        raise ValueError("no feature tells anything")
    if len(out.columns) > MAX_COLUMNS:
        raise ValueError(f"{len(out.columns)} columns are more than {MAX_COLUMNS}")
    return out


def fit_design(df: DataFrame, kinds: dict[str, str], y: str, params: "LinearParams" = None, w: str | None = None, bins: BinParams = BinParams(), schema: BinSchema | None = None) -> LinearModel:
    """A linear model of numbers and categories."""
    d = design(df, kinds, bins, schema)
    names = [f"__d{i}" for i in range(len(d.columns))]
    m = fit(d.applied(df), names, y, params or LinearParams(), w)
    m.stats = {n: m.stats[c] for n, c in zip(d.names, names)}
    m.features, m.kinds, m.design = d.names, dict(kinds), d
    return m


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, mean, sd (population) from one scan."""
    a = df.agg(*(F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("sd")).alias(c) for c in columns))
    return a.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"{c}.mean").alias("mean"), F.col(f"{c}.sd").alias("sd")) for c in columns))).alias("x")).select("x.*")


def normal_equations(df: DataFrame, columns: list[str], y: str, w: str | None = None) -> DataFrame:
    """i, j, v: the upper triangle of X'WX with an intercept at 0, and X'Wy in the column after the last."""
    cols = [F.lit(1.0), *map(F.col, columns)]
    wt = F.lit(1.0) if w is None else F.col(w)
    k = len(cols)
    cells = [(i, j, F.sum(cols[i] * cols[j] * wt)) for i in range(k) for j in range(i, k)] + [(i, k, F.sum(cols[i] * F.col(y) * wt)) for i in range(k)]
    a = df.agg(*(c.alias(f"c{i}_{j}") for i, j, c in cells))
    return a.select(F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"c{i}_{j}").alias("v")) for i, j, _ in cells))).alias("x")).select("x.*")


def ridge(df: DataFrame, columns: list[str], y: str, reg_lambda: float = 1.0) -> list[float]:
    """Intercept and weights in closed form: one aggregate, a small solve."""
    k = len(columns) + 1
    a, b = np.zeros((k, k)), np.zeros(k)
    for r in normal_equations(df, columns, y).collect():
        if r.j == k:
            b[r.i] = r.v
        else:
            a[r.i, r.j] = a[r.j, r.i] = r.v
    return np.linalg.solve(a + np.diag([0.0] + [reg_lambda] * (k - 1)), b).tolist()


def scaled(columns: list[str], stats: dict[str, tuple[float, float]]) -> list[Column]:
    """Standardised columns; missing takes the mean, a constant column gives 0."""
    return [F.coalesce((F.col(c) - stats[c][0]) / stats[c][1], F.lit(0.0)) if stats[c][1] else F.lit(0.0) for c in columns]


def fit(df: DataFrame, columns: list[str], y: str, params: LinearParams = LinearParams(), w: str | None = None) -> LinearModel:
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    stats = {r["feature"]: (r["mean"], r["sd"]) for r in moments(df, columns).collect()} if params.standardize else {c: (0.0, 1.0) for c in columns}
    wt = F.lit(1.0) if w is None else F.col(w)
    if params.objective == "logistic" and params.scale_pos_weight != 1:
        wt = wt * F.when(F.col(y) > 0.5, params.scale_pos_weight).otherwise(1.0)
    d = df.select(F.col(y).cast("double").alias("__y"), wt.cast("double").alias("__w"), *(c.alias(f"__x{i}") for i, c in enumerate(scaled(columns, stats))))
    d = VectorAssembler(inputCols=[f"__x{i}" for i in range(len(columns))], outputCol="__v").transform(d).select("__y", "__w", "__v").cache()
    a = d.agg(F.sum("__w").alias("n"), F.sum(F.col("__w") * F.col("__y")).alias("sy"), F.sum(F.col("__w") * F.col("__w")).alias("ww")).first()
    n, s = a["n"], 1.0
    if params.objective == "squared_error":
        v = d.agg(F.sum(F.col("__w") * F.pow(F.col("__y") - a["sy"] / n, 2)).alias("v")).first()["v"]
        s = float(np.sqrt(v / (n - a["ww"] / n))) or 1.0
    lam, alpha = params.reg_lambda * s, params.reg_alpha
    common = dict(featuresCol="__v", labelCol="__y", weightCol="__w", maxIter=params.max_iter, tol=params.tol, standardization=False, regParam=(alpha + lam) / n, elasticNetParam=alpha / (alpha + lam) if alpha + lam else 0.0)
    if params.objective == "squared_error":
        m = LinearRegression(solver="l-bfgs", **common).fit(d)
        coefs, bias = [list(m.coefficients)], [m.intercept]
    else:
        m = LogisticRegression(family="multinomial" if params.objective == "softmax" else "binomial", **common).fit(d)
        coefs, bias = m.coefficientMatrix.toArray().tolist(), list(m.interceptVector)
    d.unpersist()
    return LinearModel(list(columns), coefs, bias, stats, params.objective, m.summary.totalIterations >= params.max_iter)


def standard(model: LinearModel) -> list[Column]:
    """The standardised columns of a model."""
    if model.design is None:
        return scaled(model.features, model.stats)
    return [(v - model.stats[n][0]) / model.stats[n][1] if model.stats[n][1] else F.lit(0.0) for n, v in zip(model.features, model.design.values())]


def raw_scores(model: LinearModel) -> list[Column]:
    xs = standard(model)
    return [sum((x * c for x, c in zip(xs, cs)), F.lit(float(b))) for cs, b in zip(model.coefficients, model.intercepts)]


def predict(df: DataFrame, model: LinearModel) -> DataFrame:
    """df with prediction (logistic, squared error) or probabilities."""
    from ..functions.losses import sigmoid, softmax

    lacking = [c for c in model.inputs if c not in df.columns]
    if lacking:
        raise ValueError(f"no column {', '.join(lacking)}")
    raws = raw_scores(model)
    if model.objective == "softmax":
        return df.withColumn("prediction", F.array(*softmax(raws)))
    return df.withColumn("prediction", sigmoid(raws[0]) if model.objective == "logistic" else raws[0])
