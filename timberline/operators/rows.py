"""Labels, weights, hold-outs, folds and row sampling. Random choices follow md5(seed|id), so any engine can repeat them."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import hashed_positions, md5_key


def encode_labels(df: DataFrame, label: str, numeric: bool = False, most: int = 10_000) -> DataFrame:
    """class, index: classes in order. One class, or too many, are refused."""
    value = F.col(label).cast("double") if numeric else F.col(label).cast("string")
    classes = df.where(value.isNotNull()).select(value.alias("class")).distinct()
    found = classes.limit(most + 1).count()
    if not 1 < found <= most:
        raise ValueError(f"{label} has {'one class' if found == 1 else 'no class' if not found else f'more than {most} classes'}")
    return classes.select("class", (F.row_number().over(Window.orderBy("class")) - 1).cast("long").alias("index"))


def class_weights(df: DataFrame, label: str, weight: str | None = None) -> DataFrame:
    """class, weight: every class totals the same."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    sums = df.groupBy(F.col(label).alias("class")).agg(F.sum(w).alias("wc"))
    both = sums.agg(F.sum("wc").alias("total"), F.count("*").alias("k"))
    return sums.join(F.broadcast(both)).select("class", F.try_divide(F.col("total"), F.col("k") * F.col("wc")).alias("weight"))


def check_weights(df: DataFrame, weight: str) -> None:
    w = F.col(weight).cast("double")
    bad = df.agg(F.count(F.when(w.isNull() | F.isnan(w) | (w < 0) | (w == float("inf")), 1)).alias("bad"), F.sum(w).alias("total")).first()
    if bad["bad"] or not bad["total"]:
        raise ValueError(f"weights in {weight} must be finite, not negative and not all zero")


def check_labels(df: DataFrame, label: str, objective: str) -> None:
    y = F.col(label).cast("double")
    s = df.agg(F.count(F.when(y.isNull() | F.isnan(y), 1)).alias("missing"), F.min(y).alias("lo"), F.max(y).alias("hi")).first()
    if s["missing"] or s["lo"] is None:
        raise ValueError(f"{s['missing']} labels are missing")
    if objective == "logistic" and (s["lo"] < 0 or s["hi"] > 1 or s["lo"] == s["hi"]):
        raise ValueError("logistic labels must lie between 0 and 1 and have two values")
    if objective == "poisson" and s["lo"] < 0:
        raise ValueError("Poisson labels must not be negative")


def holdout(df: DataFrame, ids: list[str], fraction: float, seed: int = 1) -> DataFrame:
    """Adds is_valid: exactly round(n * fraction) rows are true."""
    if not 0 <= fraction < 1:
        raise ValueError("the fraction must be at least 0 and below 1")
    k = F.broadcast(df.agg(F.round(F.count("*") * fraction).cast("long").alias("__k")))
    return hashed_positions(df, seed, ids, "__p").join(k).withColumn("is_valid", F.col("__p") < F.col("__k")).drop("__p", "__k")


def split_column(col: Column) -> Column:
    """Validation from 0.5; below or missing trains."""
    return F.coalesce(col >= 0.5, F.lit(False))


def folds(df: DataFrame, ids: list[str], k: int = 5, seed: int = 1, label: str | None = None, name: str = "fold") -> DataFrame:
    """Deals rows from one counter: all in hashed order, or by class, highest first."""
    if k < 2:
        raise ValueError("at least two folds are needed")
    first = [-F.col(label).cast("double")] if label else []
    return hashed_positions(df, seed, ids, "__p", first).withColumn(name, (F.col("__p") % k).cast("int")).drop("__p")


def grouped_folds(df: DataFrame, group: str, k: int = 5, seed: int = 1, name: str = "fold") -> DataFrame:
    """Whole groups, largest first, each to the lightest fold. Group sizes, not rows, come to the driver."""
    sizes = df.groupBy(group).agg(F.count("*").alias("n")).withColumn("h", md5_key(seed, group)).orderBy(F.desc("n"), "h").collect()
    if len(sizes) < k:
        raise ValueError(f"{len(sizes)} groups are too few for {k} folds")
    heap, rows = [(0, f) for f in range(k)], []
    for r in sizes:
        load, f = heapq.heappop(heap)
        rows.append((r[group], f))
        heapq.heappush(heap, (load + r["n"], f))
    table = df.sparkSession.createDataFrame(rows, f"{group} {dict(df.dtypes)[group]}, {name} int")
    return df.join(table, group)


def stop_slice(df: DataFrame, ids: list[str], seed: int = 1, label: str | None = None) -> DataFrame:
    """Adds is_stop: one part of ten, dealt like folds under another seed, for early stopping."""
    return folds(df, ids, 10, seed ^ 0x5EED, label, "__part").withColumn("is_stop", F.col("__part") == 0).drop("__part")


def sample_rows(df: DataFrame, ids: list[str], rate: float, seed: int = 0) -> DataFrame:
    """Exactly clamp(round(n * rate), 1, n) rows."""
    k = F.broadcast(df.agg(F.least(F.count("*"), F.greatest(F.lit(1), F.round(F.count("*") * rate))).cast("long").alias("__k")))
    return hashed_positions(df, seed, ids, "__p").join(k).where("__p < __k").drop("__p", "__k")


def goss(df: DataFrame, ids: list[str], key: Column, top_rate: float = 0.2, other_rate: float = 0.1, seed: int = 0, g: str = "g", h: str = "h") -> DataFrame:
    """The rows of the largest key, and a sample of the rest whose g and h are scaled by (1 - top) / other; adds is_top."""
    from .order import positions, range_of

    if top_rate + other_rate > 1 or other_rate <= 0:
        raise ValueError("top_rate and other_rate must sum to 1 at most")
    scored = df.withColumn("__s", key)
    cuts = scored.approxQuantile("__s", [i / 64 for i in range(1, 64)], 0.01)
    bucket = -range_of(F.col("__s"), cuts)
    placed = positions(scored, [bucket], [F.desc("__s"), *ids], "__p")
    n = F.broadcast(df.agg(F.round(F.count("*") * top_rate).cast("long").alias("__top"), F.round(F.count("*") * other_rate).cast("long").alias("__other")))
    marked = placed.join(n).withColumn("is_top", F.col("__p") < F.col("__top"))
    lot = hashed_positions(marked, seed, ids, "__q", [(~F.col("is_top")).cast("int")])
    kept = lot.where(F.col("is_top") | (F.col("__q") - F.col("__top") < F.col("__other")))
    up = F.when(F.col("is_top"), 1.0).otherwise((1 - top_rate) / other_rate)
    return kept.withColumn(g, F.col(g) * up).withColumn(h, F.col(h) * up).drop("__s", "__p", "__q", "__top", "__other")


def uniform(seed: int, *ids: str) -> Column:
    """A number in (0, 1) from 32 bits of md5(seed|ids)."""
    return (F.conv(F.substring(md5_key(seed, *ids), 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)


def bootstrap_weight(kind: str, ids: list[str], seed: int = 0, rate: float = 0.66, temperature: float = 1.0, mvs: tuple[Column, float, float] | None = None) -> Column:
    """bernoulli: 0 or 1; bayesian: (-ln u)^temperature; mvs: inverse of min(1, sqrt(g^2 + reg) / mu) where drawn. mvs: g, reg, mu."""
    u = uniform(seed, *ids)
    if kind == "none":
        return F.lit(1.0)
    if kind == "bernoulli":
        return F.when(u < rate, 1.0).otherwise(0.0)
    if kind == "bayesian":
        return F.pow(-F.ln(u), temperature)
    if kind == "mvs":
        g, reg, mu = mvs
        p = F.least(F.lit(1.0), F.sqrt(g * g + reg) / mu)
        return F.when(u < p, 1 / p).otherwise(0.0)
    raise ValueError(f"unknown bootstrap {kind}")


def mvs_threshold(df: DataFrame, block: str, value: str, rate: float) -> DataFrame:
    """block, mu: the threshold at which sum(min(1, value / mu)) is rate times the block's rows."""
    w = Window.partitionBy(block).orderBy(value, "__i")
    d = df.select(block, F.col(value).alias(value)).withColumn("__i", F.monotonically_increasing_id())
    d = d.withColumn("below", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("pos", F.row_number().over(w))
    d = d.withColumn("n", F.count("*").over(Window.partitionBy(block)))
    want, over = F.col("n") * rate, F.col("n") - F.col("pos")
    mu = F.try_divide(F.col("below"), want - over)
    next_ = F.lead(value).over(w)
    fits = (want > over) & (mu >= F.col(value)) & (next_.isNull() | (mu <= next_))
    return d.where("true").withColumn("mu", F.when(fits, mu)).groupBy(block).agg(F.min("mu").alias("mu"))
