"""Cross-validation, search spaces and search strategies."""

from __future__ import annotations

import itertools
import math
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import HIGHER_IS_BETTER, metric


@dataclass
class CvResult:
    oof: DataFrame
    pooled: float
    scores: list[float]

    @property
    def mean(self) -> float:
        return float(np.mean(self.scores))

    @property
    def sd(self) -> float:
        return float(np.std(self.scores))  # population


def cross_validate(df: DataFrame, y: str, fit: Callable[[DataFrame], object], predict: Callable[[DataFrame, object], DataFrame], metric_name: str = "auc", fold: str = "fold", k: int = 5, w: str | None = None, first: int | None = None) -> CvResult:
    """fit on the other folds, predict each fold on the natural scale, pool. `fold` is a column; rows with a null fold always train.

    first: only so many folds are held out (partial fidelity).
    """
    parts, scores = None, []
    for f in range(k if first is None else first):
        model = fit(df.where((F.col(fold) != f) | F.col(fold).isNull()))
        out = predict(df.where(F.col(fold) == f), model)
        scores.append(metric(metric_name, out, "prediction", y, w).first()["value"])
        parts = out if parts is None else parts.unionByName(out)
    return CvResult(parts, metric(metric_name, parts, "prediction", y, w).first()["value"], scores)


@dataclass(frozen=True)
class Axis:
    """A choice of values, or a range that may be whole-numbered or logarithmic."""

    name: str
    values: tuple = ()
    lo: float = 0.0
    hi: float = 0.0
    integer: bool = False
    log: bool = False

    @staticmethod
    def parse(spec: str) -> "Axis":
        """name=a,b,c or name=lo..hi with :int and :log behind."""
        name, sep, rest = spec.partition("=")
        if not sep or not name or not rest:
            raise ValueError(f"{spec}: name=values is wanted")
        if ".." not in rest:
            values = tuple(rest.split(","))
            if "" in values:
                raise ValueError(f"{spec}: an empty choice")
            return Axis(name, values)
        span, *marks = rest.split(":")
        if not set(marks) <= {"int", "log"}:
            raise ValueError(f"{spec}: only :int and :log may follow a range")
        lo, hi = map(float, span.split(".."))
        if not lo < hi or "log" in marks and lo <= 0:
            raise ValueError(f"{spec}: the range is empty or not positive")
        return Axis(name, (), lo, hi, "int" in marks, "log" in marks)

    def at(self, u: float):
        """The value at a place in [0, 1]."""
        if self.values:
            return self.values[min(len(self.values) - 1, int(u * len(self.values)))]
        x = math.exp(math.log(self.lo) + u * (math.log(self.hi) - math.log(self.lo))) if self.log else self.lo + u * (self.hi - self.lo)
        return int(round(x)) if self.integer else x

    def grid(self, steps: int) -> list:
        if self.values:
            return list(self.values)
        return list(dict.fromkeys(self.at(i / (steps - 1)) for i in range(steps)))

    def near_edge(self, value) -> bool:
        """In the outer twentieth of a range, or an end of three numbers or more."""
        if self.values:
            return len(self.values) >= 3 and all(_number(v) for v in self.values) and value in (self.values[0], self.values[-1])
        f = math.log if self.log else float
        u = (f(value) - f(self.lo)) / (f(self.hi) - f(self.lo))
        return u < 0.05 or u > 0.95


def _number(v) -> bool:
    try:
        float(v)
    except ValueError:
        return False
    return True


@dataclass
class Trial:
    params: dict
    score: float
    folds: int
    ms: int = 0


def grid(axes: list[Axis], steps: int = 5, trials: int = 40) -> Iterator[dict]:
    for values in itertools.islice(itertools.product(*(a.grid(steps) for a in axes)), trials):
        yield dict(zip((a.name for a in axes), values))


def random(axes: list[Axis], trials: int = 40, seed: int = 1) -> Iterator[dict]:
    rng = np.random.default_rng(seed)
    for _ in range(trials):
        yield {a.name: a.at(float(rng.random())) for a in axes}


def _density(points: np.ndarray, x: float) -> float:
    """Kernels at the points and one over the whole axis."""
    width = max(0.05, 1.0 / (1 + len(points)))
    inner = np.exp(-0.5 * ((x - points) / width) ** 2).sum() / (width * math.sqrt(2 * math.pi)) if len(points) else 0.0
    return (inner + 1.0) / (len(points) + 1)


def propose(axes: list[Axis], seen: list[tuple[list[float], float]], rng, gamma: float = 0.25, candidates: int = 24) -> list[float]:
    """Tree-structured Parzen estimate: each axis takes the candidate likeliest under the good trials against the rest. seen: places, score (higher is better)."""
    order = sorted(seen, key=lambda s: -s[1])
    n = max(1, int(math.ceil(gamma * len(order))))
    out = []
    for i in range(len(axes)):
        good, bad = (np.array([p[i] for p, _ in part]) for part in (order[:n], order[n:]))
        width, best = max(0.05, 1.0 / (1 + len(good))), None
        for _ in range(candidates):
            x = rng.normal(good[rng.integers(len(good))], width) if rng.random() < len(good) / (len(good) + 1) else rng.random()
            x = abs(x) if x <= 1 else 2 - x
            x = float(min(max(x, 0.0), 1.0))
            ratio = _density(good, x) / _density(bad, x)
            if best is None or ratio > best[0]:
                best = ratio, x
        out.append(best[1])
    return out


def search(axes: list[Axis], evaluate: Callable[[dict, int], float], strategy: str = "random", trials: int = 40, folds: int = 5, metric_name: str = "auc", seed: int = 1, warmup: int = 12, candidates: int = 24, gamma: float = 0.25, eta: int = 3, min_folds: int = 2, grid_steps: int = 5) -> list[Trial]:
    """Trials, best first. evaluate(params, folds) gives a score; a setting that it refuses with ValueError is skipped."""
    sign = 1 if metric_name in HIGHER_IS_BETTER else -1
    done: list[Trial] = []

    spent: dict[str, int] = {}

    def run(params: dict, n: int) -> float | None:
        began = time.monotonic()
        try:
            return evaluate(params, n)
        except ValueError:
            return None
        finally:
            spent[repr(params)] = spent.get(repr(params), 0) + int(1000 * (time.monotonic() - began))

    if strategy in ("grid", "random"):
        for params in grid(axes, grid_steps, trials) if strategy == "grid" else random(axes, trials, seed):
            s = run(params, folds)
            if s is not None:
                done.append(Trial(params, s, folds, spent[repr(params)]))
    elif strategy == "bayes":
        rng, seen = np.random.default_rng(seed), []
        for t in range(trials):
            u = [float(x) for x in rng.random(len(axes))] if t < warmup or not seen else propose(axes, seen, rng, gamma, candidates)
            params = {a.name: a.at(x) for a, x in zip(axes, u)}
            s = run(params, folds)
            if s is not None:
                seen.append((u, sign * s))
                done.append(Trial(params, s, folds, spent[repr(params)]))
    elif strategy == "bandit":
        left, n = list(random(axes, trials, seed)), min_folds
        while left:
            scored = [(p, s) for p in left if (s := run(p, min(n, folds))) is not None]
            scored.sort(key=lambda x: -sign * x[1])
            if n >= folds:
                done += [Trial(p, s, folds, spent[repr(p)]) for p, s in scored]
                break
            left, n = [p for p, _ in scored[: max(1, len(scored) // eta)]], n * eta
    else:
        raise ValueError(f"unknown strategy {strategy}")
    return sorted(done, key=lambda t: -sign * t.score)


def trial_table(spark, trials: list[Trial]) -> DataFrame:
    return spark.createDataFrame([(i + 1, float(t.score), t.folds, int(t.ms), " ".join(f"{k}={v}" for k, v in sorted(t.params.items()))) for i, t in enumerate(trials)], "rank int, score double, folds int, ms long, params string")


def write_trials(spark, trials: list[Trial], path: str) -> None:
    """A CSV folder: rank, score, folds, ms, params, best first."""
    trial_table(spark, trials).coalesce(1).orderBy("rank").write.mode("overwrite").csv(path, header=True)


def write_oof(result: CvResult, path: str, y: str, fold: str = "fold", prediction: str = "prediction", digits: int = 8) -> None:
    """A CSV folder: fold, label, prediction with eight decimals; of many classes their scores, a space between."""
    kind = dict(result.oof.dtypes)[prediction]
    shown = F.format_string(f"%.{digits}f", prediction) if not kind.startswith("array") else F.array_join(F.transform(prediction, lambda x: F.format_string(f"%.{digits}f", x)), " ")
    result.oof.select(F.col(fold).alias("fold"), F.col(y).alias("label"), shown.alias("prediction")).write.mode("overwrite").csv(path, header=True)


def repeats_summary(results: list[CvResult]) -> dict[str, float]:
    """Mean and population sd of the pooled scores of repeats."""
    pooled = [r.pooled for r in results]
    return {"mean": float(np.mean(pooled)), "sd": float(np.std(pooled))}
