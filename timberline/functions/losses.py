"""Objectives: gradients, hessians, starting scores and links as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The floors and the Poisson step that results depend on.
HESS_FLOOR, SOFTMAX_FLOOR, MEAN_CLIP, POISSON_STEP = 1e-6, 1e-16, 1e-6, 0.7

OBJECTIVES = ("logistic", "squared_error", "absolute_error", "quantile", "pseudo_huber", "poisson", "softmax")


@dataclass(frozen=True)
class Loss:
    objective: str = "logistic"
    scale_pos_weight: float = 1.0
    quantile_alpha: float = 0.5
    huber_slope: float = 1.0
    poisson_max_delta_step: float = POISSON_STEP
    softmax_hessian: str = "xgboost"
    num_class: int = 0

    def __post_init__(self):
        if self.objective not in OBJECTIVES:
            raise ValueError(f"unknown objective {self.objective}")
        if not 0 < self.quantile_alpha < 1:
            raise ValueError("quantile_alpha must be between 0 and 1")
        if self.huber_slope <= 0 or self.scale_pos_weight <= 0:
            raise ValueError("huber_slope and scale_pos_weight must be positive")


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def softmax(raws: list[Column]) -> list[Column]:
    top = F.greatest(*raws) if len(raws) > 1 else raws[0]
    e = [F.exp(r - top) for r in raws]
    return [x / sum(e[1:], e[0]) for x in e]


def gradients(loss: Loss, raw: Column, y: Column, w: Column | None = None) -> tuple[Column, Column]:
    """First and second derivative of a single-score objective; the weight multiplies both after the hessian's floor."""
    d = raw - y
    kind = loss.objective
    if kind == "logistic":
        p, up = sigmoid(raw), F.when(y > 0.5, loss.scale_pos_weight).otherwise(1.0)
        g, h = up * (p - y), up * F.greatest(p * (1 - p), F.lit(HESS_FLOOR))
    elif kind == "squared_error":
        g, h = d, F.lit(1.0)
    elif kind == "absolute_error":
        g, h = F.signum(d), F.lit(1.0)
    elif kind == "quantile":
        g, h = F.when(d >= 0, 1 - loss.quantile_alpha).otherwise(-loss.quantile_alpha), F.lit(1.0)
    elif kind == "pseudo_huber":
        s2 = loss.huber_slope**2
        root = F.sqrt(1 + d * d / s2)
        g, h = d / root, s2 / ((s2 + d * d) * root)
    elif kind == "poisson":
        g, h = F.exp(raw) - y, F.exp(raw + loss.poisson_max_delta_step)
    else:
        raise ValueError("softmax has a score for each class: use softmax_gradients")
    return (g, h) if w is None else (g * w, h * w)


def softmax_gradients(loss: Loss, raws: list[Column], y: Column, w: Column | None = None) -> list[tuple[Column, Column]]:
    k, one = len(raws), F.lit(1.0) if w is None else w
    out = []
    for c, p in enumerate(softmax(raws)):
        g = (p - F.when(y == c, 1.0).otherwise(0.0)) * one
        h = F.greatest(2 * p * (1 - p) * one, F.lit(SOFTMAX_FLOOR)) if loss.softmax_hessian == "xgboost" else k / (k - 1.0) * p * (1 - p) * one
        out.append((g, h))
    return out


def base_score(df: DataFrame, loss: Loss, y: str, w: str | None = None, row: str | None = None) -> DataFrame:
    """One row: score, where boosting starts. Softmax: class, score, the centred log priors."""
    from ..operators.order import weighted_percentile

    weight = F.lit(1.0) if w is None else F.col(w)
    mean = F.sum(F.col(y) * weight) / F.sum(weight)
    kind = loss.objective
    if kind == "softmax":
        t = df.groupBy(F.col(y).cast("int").alias("class")).agg(F.sum(weight).alias("n"))
        logs = t.select("class", F.ln("n").alias("l"))
        centre = logs.agg(F.avg("l").alias("m"))
        return logs.join(F.broadcast(centre)).select("class", (F.col("l") - F.col("m")).alias("score"))
    if kind == "logistic":
        up = F.when(F.col(y) > 0.5, loss.scale_pos_weight).otherwise(1.0) * weight
        p = F.least(F.greatest(F.sum(F.col(y) * up) / F.sum(up), F.lit(MEAN_CLIP)), F.lit(1 - MEAN_CLIP))
        return df.agg(F.ln(p / (1 - p)).alias("score"))
    if kind == "poisson":
        return df.agg(F.ln(F.greatest(mean, F.lit(MEAN_CLIP))).alias("score"))
    if kind in ("absolute_error", "quantile"):
        alpha = 0.5 if kind == "absolute_error" else loss.quantile_alpha
        if w is None:
            return df.agg(F.percentile(y, alpha).alias("score"))
        return weighted_percentile(df, y, w, alpha, row).select(F.col("value").alias("score"))
    return df.agg(mean.alias("score"))


def link(loss: Loss, raw: Column) -> Column:
    """From a raw score to the natural scale."""
    if loss.objective == "logistic":
        return sigmoid(raw)
    return F.exp(raw) if loss.objective == "poisson" else raw
