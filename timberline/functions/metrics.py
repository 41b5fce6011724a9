"""Metrics as aggregates. Each returns one row with the column `value`; weights are optional everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.order import running

#: Clamps that results depend on.
PROB_CLIP, MPROB_FLOOR, RATE_FLOOR = 1e-7, 1e-15, 1e-16

HIGHER_IS_BETTER = frozenset({"auc", "aucpr", "accuracy", "r2"})
NAMES = ("auc", "aucpr", "logloss", "error_rate", "accuracy", "mlogloss", "rmse", "mae", "r2", "pinball", "mphe", "poisson_nloglik")

#: The metric of each objective when none is asked for.
DEFAULT = {"logistic": "auc", "squared_error": "rmse", "absolute_error": "mae", "quantile": "pinball", "pseudo_huber": "mphe", "poisson": "poisson_nloglik", "softmax": "mlogloss"}


def _weight(w: str | None) -> Column:
    return F.lit(1.0) if w is None else F.col(w)


def _mean(df: DataFrame, loss: Column, w: str | None) -> DataFrame:
    return df.agg(F.try_divide(F.sum(loss * _weight(w)), F.sum(_weight(w))).alias("value"))


def _levels(df: DataFrame, score: str, y: str, w: str | None) -> DataFrame:
    """Weights of both labels at each distinct score."""
    pos = F.col(y) > 0.5
    return df.groupBy(F.col(score).alias("s")).agg(F.sum(F.when(pos, _weight(w)).otherwise(0.0)).alias("p"), F.sum(F.when(pos, 0.0).otherwise(_weight(w))).alias("q"))


def _over_levels(df: DataFrame, score: str, y: str, w: str | None, sums: list[str], descending: bool, value) -> DataFrame:
    """One row: value(levels with running sums). The levels, one for each distinct score, are made once."""
    levels = _levels(df, score, y, w).persist()
    found = value(running(levels, "s", sums, descending)).first()["value"]
    levels.unpersist()
    return df.sparkSession.createDataFrame([(found,)], "value double")


def auc(df: DataFrame, score: str, y: str, w: str | None = None) -> DataFrame:
    """Ties count half; 0.5 with one class."""

    def value(t: DataFrame) -> DataFrame:
        area = t.agg(F.sum(F.col("p") * (F.col("before_q") + F.col("q") / 2)).alias("a"), F.sum("p").alias("p"), F.sum("q").alias("q"))
        return area.select(F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("a") / (F.col("p") * F.col("q"))).otherwise(0.5).alias("value"))

    return _over_levels(df, score, y, w, ["q"], False, value)


def aucpr(df: DataFrame, score: str, y: str, w: str | None = None) -> DataFrame:
    """Step average precision; 0 without positives."""
    tp, fp = F.col("before_p") + F.col("p"), F.col("before_q") + F.col("q")

    def value(t: DataFrame) -> DataFrame:
        total = t.agg(F.sum(F.when(F.col("p") > 0, F.col("p") * tp / (tp + fp)).otherwise(0.0)).alias("a"), F.sum("p").alias("p"))
        return total.select(F.when(F.col("p") > 0, F.col("a") / F.col("p")).otherwise(0.0).alias("value"))

    return _over_levels(df, score, y, w, ["p", "q"], True, value)


def logloss(df: DataFrame, score: str, y: str, w: str | None = None, raw: bool = False) -> DataFrame:
    z = F.col(score)
    if raw:
        return _mean(df, F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - F.col(y) * z, w)
    p = F.least(F.greatest(z, F.lit(PROB_CLIP)), F.lit(1 - PROB_CLIP))
    return _mean(df, -(F.col(y) * F.ln(p) + (1 - F.col(y)) * F.ln(1 - p)), w)


def _wrong(score: str, y: str, raw: bool) -> Column:
    return F.when((F.col(score) > (0.0 if raw else 0.5)) != (F.col(y) > 0.5), 1.0).otherwise(0.0)


def error_rate(df: DataFrame, score: str, y: str, w: str | None = None, raw: bool = False) -> DataFrame:
    return _mean(df, _wrong(score, y, raw), w)


def accuracy(df: DataFrame, score: str, y: str, w: str | None = None, raw: bool = False) -> DataFrame:
    """With an array of scores the first largest names the class."""
    if dict(df.dtypes)[score].startswith("array"):
        return _mean(df, F.when(F.array_position(score, F.array_max(score)) - 1 == F.col(y), 1.0).otherwise(0.0), w)
    return _mean(df, 1 - _wrong(score, y, raw), w)


def mlogloss(df: DataFrame, scores: str, y: str, w: str | None = None, raw: bool = True) -> DataFrame:
    own = F.element_at(scores, (F.col(y) + 1).cast("int"))
    if not raw:
        return _mean(df, -F.ln(F.greatest(own, F.lit(MPROB_FLOOR))), w)
    top = F.array_max(scores)
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return _mean(df, top + F.ln(total) - own, w)


def rmse(df: DataFrame, score: str, y: str, w: str | None = None) -> DataFrame:
    return _mean(df, F.pow(F.col(score) - F.col(y), 2), w).select(F.sqrt("value").alias("value"))


def mae(df: DataFrame, score: str, y: str, w: str | None = None) -> DataFrame:
    return _mean(df, F.abs(F.col(score) - F.col(y)), w)


def r2(df: DataFrame, score: str, y: str, w: str | None = None) -> DataFrame:
    """A constant target gives 1 if it is met, else 0."""
    wt, t, p = _weight(w), F.col(y), F.col(score)
    mean = df.agg(F.try_divide(F.sum(wt * t), F.sum(wt)).alias("__m"))
    s = df.join(F.broadcast(mean)).agg(F.sum(wt * F.pow(t - p, 2)).alias("res"), F.sum(wt * F.pow(t - F.col("__m"), 2)).alias("tot"))
    return s.select(F.when(F.col("tot") > 0, 1 - F.col("res") / F.col("tot")).when(F.col("res") == 0, 1.0).otherwise(0.0).alias("value"))


def pinball(df: DataFrame, score: str, y: str, w: str | None = None, alpha: float = 0.5) -> DataFrame:
    d = F.col(y) - F.col(score)
    return _mean(df, F.when(d >= 0, alpha * d).otherwise((alpha - 1) * d), w)


def mphe(df: DataFrame, score: str, y: str, w: str | None = None, slope: float = 1.0) -> DataFrame:
    r = F.col(score) - F.col(y)
    return _mean(df, slope**2 * (F.sqrt(1 + F.pow(r / slope, 2)) - 1), w)


def log_factorial(y: Column, series: int = 9) -> Column:
    """ln(y!), by Stirling's series above the first few; no table, no Python. Error under 1e-12 for y >= 0."""
    x = y + 1.0
    small = F.when(x < series, F.ln(F.aggregate(F.sequence(F.lit(0), F.lit(series - 1)), F.lit(1.0), lambda a, i: a * F.when(x + i < series, x + i).otherwise(1.0)))).otherwise(0.0)
    z = F.when(x < series, x + F.ceil(series - x)).otherwise(x)
    r = 1.0 / z
    tail = r * (1 / 12.0 - r * r * (1 / 360.0 - r * r * (1 / 1260.0 - r * r * (1 / 1680.0 - r * r * (1 / 1188.0)))))
    return (z - 0.5) * F.ln(z) - z + 0.9189385332046727 + tail - small


def poisson_nloglik(df: DataFrame, score: str, y: str, w: str | None = None) -> DataFrame:
    mu = F.greatest(F.col(score), F.lit(RATE_FLOOR))
    return _mean(df, mu - F.col(y) * F.ln(mu) + log_factorial(F.col(y)), w)


def metric(name: str, df: DataFrame, score: str, y: str, w: str | None = None, **how) -> DataFrame:
    if name not in NAMES:
        raise ValueError(f"unknown metric {name}")
    return globals()[name](df, score, y, w, **how)
