"""Positions, running sums and percentiles over all rows without ordering them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def md5_key(seed: int, *cols: str) -> Column:
    """A keyed order that other engines reproduce."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in cols)))


def positions(df: DataFrame, bucket: list[Column], order: list[Column | str], name: str = "pos") -> DataFrame:
    """Adds the position from 0 in the order (bucket, order). Buckets are few; each is numbered on its own.

    Only the buckets' counts meet in one task.
    """
    keyed = df.withColumn("__b", F.struct(*(c.alias(f"k{i}") for i, c in enumerate(bucket))))
    sizes = keyed.groupBy("__b").agg(F.count("*").alias("__n"))
    before = sizes.select("__b", F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__b").orderBy(*order))
    return keyed.join(F.broadcast(before), "__b").withColumn(name, F.col("__before") + inside - 1).drop("__b", "__before")


def hashed_positions(df: DataFrame, seed: int, ids: list[str], name: str = "pos", first: list[Column] = ()) -> DataFrame:
    """Positions in the order of md5(seed|ids), after the columns `first` if given."""
    key = df.withColumn("__key", md5_key(seed, *ids))
    return positions(key, [*first, F.substring("__key", 1, 2)], ["__key", *ids], name).drop("__key")


def range_of(key: Column, cuts: list[float]) -> Column:
    """How many cuts lie below the key: plain arithmetic, which joins and filters may be pushed through."""
    return sum(((key > c).cast("int") for c in sorted(set(cuts))), F.lit(0))


#: So many keys may be ordered in one task; more are dealt to ranges.
FEW = 1 << 17


def running(df: DataFrame, key: str, sums: list[str], descending: bool = False, buckets: int = 64, few: int = FEW) -> DataFrame:
    """df has a row for each key. Adds before_<s> for each of sums: its sum over the keys that come before.

    More than `few` keys are dealt to ranges by approximate quantiles; each range is summed in order, from the ranges' totals
    before it. df is read several times: persist it, or give a table.
    """
    order = F.desc(key) if descending else F.asc(key)
    if df.limit(few + 1).count() <= few:
        back = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({f"before_{s}": F.coalesce(F.sum(s).over(back), F.lit(0)) for s in sums})
    cuts = sorted(set(df.approxQuantile(key, [i / buckets for i in range(1, buckets)], 0.01)))
    place = range_of(F.col(key), cuts)
    if descending:
        place = -place
    dealt = df.withColumn("__r", place)
    back = Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("__r").agg(*(F.sum(s).alias(f"__t_{s}") for s in sums))
    heads = totals.select("__r", *(F.coalesce(F.sum(f"__t_{s}").over(back), F.lit(0)).alias(f"__h_{s}") for s in sums))
    inside = Window.partitionBy("__r").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(heads), "__r")
    for s in sums:
        out = out.withColumn(f"before_{s}", F.col(f"__h_{s}") + F.coalesce(F.sum(s).over(inside), F.lit(0)))
    return out.drop("__r", *(f"__h_{s}" for s in sums))


def weighted_percentile(df: DataFrame, value: str, weight: str, alpha: float, row: str | None = None, few: int = FEW) -> DataFrame:
    """value: that of the first row, by value and then row id, at which the running weight passes alpha times the total; between
    it and the row before where its own weight is 1 or more, but for the very first and last row. Without row ids the
    lightest of equal values comes first."""
    first = F.min_by(weight, row) if row else F.min(weight)
    rows = df.where(F.col(weight) > 0).groupBy(F.col(value).alias("v")).agg(F.sum(weight).alias("w"), first.alias("first"), F.count("*").alias("n")).persist()
    sums = running(rows, "v", ["w"], few=few).withColumn("cdf", F.col("before_w") + F.col("w"))
    total = rows.agg(F.sum("w").alias("total"), F.max("v").alias("top"))
    passed = sums.join(F.broadcast(total)).withColumn("t", F.col("total") * alpha)
    at = passed.where("cdf > t").agg(F.min_by(F.struct("v", "first", "n", "before_w", "t", "top"), "v").alias("hi"))
    below = passed.where("cdf <= t").agg(F.max("v").alias("lo"))
    r = at.join(F.broadcast(below)).join(F.broadcast(total)).first()
    rows.unpersist()
    out = None
    if r is not None and r["top"] is not None:
        hi, lo = r["hi"], r["lo"]
        if hi is None:
            out = r["top"]
        elif lo is None or hi["t"] >= hi["before_w"] + hi["first"] or (hi["v"] == hi["top"] and hi["n"] == 1):
            out = hi["v"]
        else:
            out = lo + (hi["t"] - hi["before_w"]) / hi["first"] * (hi["v"] - lo) if hi["first"] >= 1 else lo
    return df.sparkSession.createDataFrame([(None if out is None else float(out),)], "value double")
