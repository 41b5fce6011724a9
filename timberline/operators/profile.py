"""Column profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def profile(df: DataFrame, numeric: list[str], categorical: list[str] = ()) -> DataFrame:
    """A row for each column: column, kind, missing, distinct, min, q1, median, q3, max, mean, far_low, far_high.

    Columns become rows in one scan; quartiles interpolate linearly; far values lie more than three quartile distances outside.
    """
    out = None
    if numeric:
        long = df.select(*(F.col(c).cast("double").alias(c) for c in numeric)).unpivot([], list(numeric), "column", "v")
        runs = long.groupBy("column", "v").agg(F.count("*").alias("n"))  # each value once: what follows is by distinct value
        quart = lambda i: F.col("q")[i]
        stats = runs.groupBy("column").agg(F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("missing"), F.count("v").alias("distinct"), F.min("v").alias("min"), F.max("v").alias("max"), (F.sum(F.col("v") * F.col("n")) / F.sum(F.when(F.col("v").isNotNull(), F.col("n")))).alias("mean"), F.percentile("v", F.array(*map(F.lit, (0.25, 0.5, 0.75))), F.col("n")).alias("q"))
        stats = stats.select("column", F.lit("numeric").alias("kind"), "missing", "distinct", "min", quart(0).alias("q1"), quart(1).alias("median"), quart(2).alias("q3"), "max", "mean")
        iqr = F.col("q3") - F.col("q1")
        far = runs.join(F.broadcast(stats.select("column", "q1", "q3")), "column").groupBy("column").agg(F.coalesce(F.sum(F.when((iqr > 0) & (F.col("v") < F.col("q1") - 3 * iqr), F.col("n"))), F.lit(0)).alias("far_low"), F.coalesce(F.sum(F.when((iqr > 0) & (F.col("v") > F.col("q3") + 3 * iqr), F.col("n"))), F.lit(0)).alias("far_high"))
        out = stats.join(F.broadcast(far), "column")
    if categorical:
        long = df.select(*(F.col(c).cast("string").alias(c) for c in categorical)).unpivot([], list(categorical), "column", "v")
        runs = long.groupBy("column", "v").agg(F.count("*").alias("n"))
        none = [F.lit(None).cast("double").alias(c) for c in ("min", "q1", "median", "q3", "max", "mean")]
        cats = runs.groupBy("column").agg(F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("missing"), F.count("v").alias("distinct"))
        cats = cats.select("column", F.lit("categorical").alias("kind"), "missing", "distinct", *none, F.lit(0).cast("long").alias("far_low"), F.lit(0).cast("long").alias("far_high"))
        out = cats if out is None else out.unionByName(cats)
    return out


def summary(stats: DataFrame, rows: int) -> DataFrame:
    """cells, missing share, empty and constant columns, and categories too wide to bin."""
    return stats.agg((F.count("*") * rows).alias("cells"), (F.sum("missing") / (F.count("*") * rows)).alias("missing_share"), F.count(F.when(F.col("distinct") == 0, 1)).alias("empty"), F.count(F.when(F.col("distinct") == 1, 1)).alias("constant"), F.count(F.when((F.col("kind") == "categorical") & (F.col("distinct") >= 256), 1)).alias("wide"))


def unparsed(df: DataFrame, numeric: list[str]) -> DataFrame:
    """column, unparsed: the fields of text columns read as numbers that are neither a number nor a missing marker."""
    from ..sources.tables import as_number, is_missing

    counts = df.agg(*(F.count(F.when(~is_missing(F.col(c)) & as_number(F.col(c)).isNull(), 1)).alias(c) for c in numeric))
    return counts.unpivot([], list(numeric), "column", "unparsed")


def wide(stats: DataFrame, levels: int = 256) -> DataFrame:
    """column, distinct: the categories with so many levels that binning refuses them, widest first."""
    return stats.where((F.col("kind") == "categorical") & (F.col("distinct") >= levels)).select("column", "distinct").orderBy(F.desc("distinct"), "column")
