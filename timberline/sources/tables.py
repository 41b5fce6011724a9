"""Reading, kinds, missing markers, dictionaries, appending and writing."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What counts as missing, in any case, after trimming.
MARKERS = ("", "na", "n/a", "#n/a", "nan", "null", "none", "nil", "?")
SNIFF_ROWS = 1000
MAX_LEVELS = 1 << 20

#: A number as text: guards the cast from suffixes that only some engines take.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(inf|infinity|INF|Infinity)$"
ROW = "row_id"


@dataclass
class Frame:
    """A table with a row id, its columns' kinds, and what was odd about its file."""

    df: DataFrame
    kinds: dict[str, str]
    notes: dict[str, int] = field(default_factory=dict)
    held: DataFrame | None = None  # the file's fields as text, kept in memory

    def release(self) -> None:
        """Gives back the memory of the file's fields; the table can still be read, from the file."""
        if self.held is not None:
            self.held.unpersist()


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def is_missing(c: Column) -> Column:
    return c.isNull() | F.lower(trimmed(c)).isin(*MARKERS)


def as_number(c: Column) -> Column:
    """The number, or null for a marker or anything else. NaN never enters a plan."""
    t = trimmed(c)
    return F.when(~is_missing(c) & t.rlike(NUMBER), t.try_cast("double"))


def as_category(c: Column) -> Column:
    """Only the empty field is missing in a categorical column."""
    t = trimmed(c)
    return F.when(t != "", t)


def sniff(df: DataFrame, columns: list[str], rows: int = SNIFF_ROWS) -> DataFrame:
    """column, kind: numeric when each of the first rows is a number or a marker."""
    first = df.where(F.col(ROW) < rows)
    flags = first.agg(*(F.coalesce(F.bool_and(is_missing(F.col(c)) | as_number(F.col(c)).isNotNull()), F.lit(True)).alias(c) for c in columns))
    kind = F.when(F.col("numeric"), "numeric").otherwise("categorical").alias("kind")
    return flags.unpivot([], columns, "column", "numeric").select("column", kind)


def spans_lines(spark: SparkSession, path: str) -> bool:
    """Whether some record may go over a line's end: a line with an odd number of quotes. If none does, files can be split."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def read_csv(spark: SparkSession, path: str, kinds: dict[str, str] | None = None, exact_shape: bool = True) -> Frame:
    """All fields as text first; kinds sniffed or, for a stored model, given. Long records are refused, short ones padded."""
    multi = spans_lines(spark, path)
    head = spark.read.option("maxCharsPerColumn", -1).csv(path, header=True, multiLine=multi, escape='"', inferSchema=False)
    names = head.columns
    schema = T.StructType([*(T.StructField(n, T.StringType()) for n in names), T.StructField("__bad", T.StringType())])
    raw = spark.read.schema(schema).csv(path, header=True, multiLine=multi, escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="__bad", maxCharsPerColumn=-1)
    from ..operators.order import positions

    numbered = positions(raw.withColumn("__f", F.input_file_name()).withColumn("__m", F.monotonically_increasing_id()), [F.col("__f"), F.shiftright("__m", 33)], ["__m"], ROW).drop("__f", "__m").cache()
    fields = F.size(F.split(F.regexp_replace("__bad", r'"[^"]*"', ""), ","))
    shape = numbered.agg(F.count(F.when(fields > len(names), 1)).alias("long"), F.count(F.when(F.col("__bad").isNotNull() & (fields < len(names)), 1)).alias("short"), F.min(F.when(fields > len(names), F.col(ROW))).alias("first_long")).first()
    if shape["long"] and exact_shape:
        raise ValueError(f"{shape['long']} records have more than {len(names)} fields; the first is row {shape['first_long']}")
    text = numbered.drop("__bad")
    found = dict(kinds or {})
    rest = [n for n in names if n not in found]
    if rest:
        found |= {r["column"]: r["kind"] for r in sniff(text, rest).collect()}
    unparsed = text.agg(*(F.count(F.when(~is_missing(F.col(n)) & as_number(F.col(n)).isNull(), 1)).alias(n) for n in names if found[n] == "numeric")).first() if "numeric" in found.values() else None
    df = text.select(ROW, *((as_number if found[n] == "numeric" else as_category)(F.col(n)).alias(n) for n in names))
    return Frame(df, {n: found[n] for n in names}, {"short_rows": shape["short"], "long_rows": shape["long"], **({f"unparsed:{k}": v for k, v in unparsed.asDict().items() if v} if unparsed else {})}, numbered)


def dictionary(df: DataFrame, column: str, row: str = ROW) -> DataFrame:
    """level, id: ids from 0 in the order in which levels first appear."""
    first = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("level")).agg(F.min(row).alias("first_row"))
    if first.limit(MAX_LEVELS + 1).count() > MAX_LEVELS:
        raise ValueError(f"{column} has more than {MAX_LEVELS} levels")
    # So one ordered task is enough.
    return first.select("level", (F.row_number().over(Window.orderBy("first_row", "level")) - 1).cast("long").alias("id"))


def append(main: Frame, extra: Frame, may_lack: set[str] = frozenset()) -> Frame:
    """Rows of extra after main's, with an is_extra flag. Refused: columns only in extra, kinds that differ, columns lacking without leave."""
    only = [c for c in extra.kinds if c not in main.kinds]
    lacking = [c for c in main.kinds if c not in extra.kinds and c not in may_lack]
    differ = [c for c in extra.kinds if c in main.kinds and extra.kinds[c] != main.kinds[c]]
    for bad, what in ((only, "are only in the extra rows"), (lacking, "are lacking in the extra rows"), (differ, "have another kind in the extra rows")):
        if bad:
            raise ValueError(f"columns {', '.join(bad)} {what}")
    last = main.df.agg(F.coalesce(F.max(ROW), F.lit(-1)).alias("last"))
    moved = extra.df.join(F.broadcast(last)).withColumn(ROW, F.col(ROW) + F.col("last") + 1).drop("last").withColumn("is_extra", F.lit(True))
    both = main.df.withColumn("is_extra", F.lit(False)).unionByName(moved, allowMissingColumns=True)
    return Frame(both, dict(main.kinds), {k: main.notes.get(k, 0) + extra.notes.get(k, 0) for k in {*main.notes, *extra.notes}})


def drop_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """A name that isn't there is refused."""
    unknown = [n for n in names if n not in df.columns]
    if unknown:
        raise ValueError(f"no column {', '.join(unknown)}")
    return df.drop(*names)


def shown_id(df: DataFrame, id_col: str) -> Column:
    """An id as text: whole numbers under 2^24 without a point, nothing where it is missing."""
    kind, c = dict(df.dtypes)[id_col], F.col(id_col)
    if kind in ("float", "double"):
        whole = (c == F.floor(c)) & (F.abs(c) < 1 << 24)
        text = F.when(whole, c.cast("long").cast("string")).otherwise(c.cast("string"))
        return F.when(c.isNull() | F.isnan(c), "").otherwise(text).alias(id_col)
    return F.coalesce(c.cast("string"), F.lit("")).alias(id_col)


def write_predictions(df: DataFrame, path: str, scores: list[str], id_col: str | None = None, digits: int = 6) -> None:
    """A CSV folder: the id if any, then scores with six decimals."""
    df.select(*([shown_id(df, id_col)] if id_col else []), *(F.format_string(f"%.{digits}f", c).alias(c) for c in scores)).write.mode("overwrite").csv(path, header=True)
