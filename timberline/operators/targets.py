"""Ordered target statistics for categories, and what symmetric trees need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import range_of
from .splits import SplitParams

BORDERS = 15


def bucket(value: Column) -> Column:
    """0 to 15, in 32-bit arithmetic."""
    return F.least(F.floor(value.cast("float") * F.lit(float(BORDERS)).cast("float")), F.lit(BORDERS)).cast("int")


def ctr_borders(df: DataFrame, level: str | list[str], y: str, order: list[str], prior: float) -> Column:
    """The bucket of (positives before + prior) / (rows before + 1) among rows of the same level, as a column."""
    levels = [level] if isinstance(level, str) else level
    before = Window.partitionBy(*levels).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    pos = F.coalesce(F.sum(F.when(F.col(y) > 0.5, 1).otherwise(0)).over(before), F.lit(0))
    n = F.count("*").over(before)
    value = (pos.cast("float") + F.lit(prior).cast("float")).cast("float") / (n.cast("float") + F.lit(1.0).cast("float"))
    return F.when(F.col(levels[0]).isNull(), 0).otherwise(bucket(value))


def before_counts(df: DataFrame, levels: list[str], y: str, row: str, chunks: int = 64) -> DataFrame:
    """df with __pos and __n: positives and rows of the same level before each row.

    Rows are cut into ranges of the row id. A level's counts of whole ranges are summed first, so a level that most rows
    have is still counted range by range, in as many tasks as there are ranges.
    """
    cuts = sorted(set(df.approxQuantile(row, [i / chunks for i in range(1, chunks)], 0.01)))
    d = df.withColumn("__chunk", range_of(F.col(row), cuts)).withColumn("__hit", F.when(F.col(y) > 0.5, 1).otherwise(0))
    d = d.withColumn("__g", F.concat_ws("\x1f", *(F.coalesce(F.col(x).cast("string"), F.lit("\x00")) for x in levels)))
    sums = d.groupBy("__g", "__chunk").agg(F.sum("__hit").alias("__p"), F.count("*").alias("__c"))
    back = Window.partitionBy("__g").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    heads = sums.select("__g", "__chunk", F.coalesce(F.sum("__p").over(back), F.lit(0)).alias("__hp"), F.coalesce(F.sum("__c").over(back), F.lit(0)).alias("__hc"))
    inside = Window.partitionBy("__g", "__chunk").orderBy(row).rowsBetween(Window.unboundedPreceding, -1)
    out = d.join(heads, ["__g", "__chunk"]).withColumn("__pos", F.col("__hp") + F.coalesce(F.sum("__hit").over(inside), F.lit(0))).withColumn("__n", F.col("__hc") + F.count("*").over(inside))
    return out.drop("__g", "__chunk", "__hit", "__hp", "__hc")


def ctr_final(df: DataFrame, level: str | list[str], y: str, prior: float) -> DataFrame:
    """level, bucket from all rows: what a model stores."""
    levels = [level] if isinstance(level, str) else level
    t = df.groupBy(*levels).agg(F.sum(F.when(F.col(y) > 0.5, 1).otherwise(0)).alias("pos"), F.count("*").alias("n"))
    value = (F.col("pos").cast("float") + F.lit(prior).cast("float")).cast("float") / (F.col("n").cast("float") + F.lit(1.0).cast("float"))
    return t.select(*levels, F.when(F.col(levels[0]).isNull(), 0).otherwise(bucket(value)).alias("bucket"))


def ctr_counter(df: DataFrame, level: str) -> DataFrame:
    """level, bucket of n / (largest n + 1)."""
    t = df.where(F.col(level).isNotNull()).groupBy(level).agg(F.count("*").alias("n"))
    top = t.agg(F.max("n").alias("top"))
    return t.join(F.broadcast(top)).select(level, bucket(F.col("n").cast("float") / (F.col("top").cast("float") + F.lit(1.0).cast("float"))).alias("bucket"))


def ordered_prefixes(n: int) -> list[tuple[int, int]]:
    """(body, tail): the body starts small and doubles until the tail is all rows."""
    body = 1 if n <= 500 else min(100, n // 50)
    out = []
    while body < n:
        out.append((body, min(2 * body, n)))
        body *= 2
    return out


def prefix_sums(df: DataFrame, pos: str, bin_col: str, threshold: int, g: Column, prefixes: list[tuple[int, int]]) -> DataFrame:
    """prefix, side, body_g, body_n, tail_g: what scores one split under ordered boosting, all prefixes in one scan."""
    side = F.when(F.col(bin_col) > threshold, 1).otherwise(0).alias("side")
    spans = F.array(*(F.struct(F.lit(i).alias("prefix"), F.lit(b).alias("body"), F.lit(t).alias("tail")) for i, (b, t) in enumerate(prefixes)))
    d = df.select(F.col(pos).alias("pos"), side, g.alias("g"), F.explode(spans).alias("s")).where("pos < s.tail")
    inside = F.col("pos") < F.col("s.body")
    return d.groupBy(F.col("s.prefix").alias("prefix"), "side").agg(F.coalesce(F.sum(F.when(inside, F.col("g"))), F.lit(0.0)).alias("body_g"), F.count(F.when(inside, 1)).alias("body_n"), F.coalesce(F.sum(F.when(~inside, F.col("g"))), F.lit(0.0)).alias("tail_g"))


def symmetric_scores(hist: DataFrame, kind: str, p: SplitParams = SplitParams(), leaf: list[str] = ()) -> DataFrame:
    """feature, threshold, score of one test for all leaves. hist: leaf.., feature, bin, n, g, h. Missing stays left."""
    part = Window.partitionBy(*leaf, "feature")
    run = part.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    d = hist.select(*leaf, "feature", "bin", *(F.sum(x).over(run).alias(f"l_{x}") for x in "ngh"), *(F.sum(x).over(part).alias(f"t_{x}") for x in "ngh"))
    lam = p.reg_lambda
    sides = [(F.col("l_g"), F.col("l_n"), F.col("l_h")), *[tuple(F.col(f"t_{x}") - F.col(f"l_{x}") for x in "gnh")]]
    v = lambda g, n: F.coalesce(F.try_divide(g, n + lam), F.lit(0.0))
    if kind == "gain":
        parts = {"a": sum((F.coalesce(F.try_divide(g * g, h + lam), F.lit(0.0)) for g, _, h in sides[1:]), F.coalesce(F.try_divide(sides[0][0] * sides[0][0], sides[0][2] + lam), F.lit(0.0))), "b": F.lit(0.0)}
    else:
        parts = {"a": sum((v(g, n) * g for g, n, _ in sides[1:]), v(sides[0][0], sides[0][1]) * sides[0][0]), "b": sum((v(g, n) * v(g, n) * n for g, n, _ in sides[1:]), v(sides[0][0], sides[0][1]) * v(sides[0][0], sides[0][1]) * sides[0][1])}
    both = d.where("l_n > 0 AND l_n < t_n") if not leaf else d
    agg = both.select("feature", F.col("bin").alias("threshold"), parts["a"].alias("a"), parts["b"].alias("b")).groupBy("feature", "threshold").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return agg.select("feature", "threshold", (F.col("a") / F.sqrt(F.col("b") + 1e-100) if kind == "cosine" else F.col("a")).alias("score"))
