"""What the operators of this subpackage share: tables, word rules and shared storage."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The whole text, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Bounds what one Arrow batch holds, in rows and bytes, so that long texts don't fill a Python worker. It stays set for the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the cluster names none (local tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = os.path.join(tempfile.gettempdir(), "timberline-shared")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts lineage in a way that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes tables made by written() once nothing will read them again."""
    for df in frames:
        for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def by_key(batches, width: int, run) -> Iterator:
    """Calls run(rows) for each run of equal keys (the first `width` columns) in sorted batches; one run is held at a time."""
    now, rows = None, []
    for b in batches:
        cols = [c.to_pylist() for c in b.columns]
        for row in zip(*cols):
            if row[:width] != now:
                if rows:
                    yield from run(now, rows)
                now, rows = row[:width], []
            rows.append(row[width:])
    if rows:
        yield from run(now, rows)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps that are over, which it does once their plans are collected as garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def whole_runs(batches, width: int, rows: int = 4096, size: int = 8 << 20) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of equal keys (the first `width` columns, numbers) of sorted batches, and where the runs begin.

    Short runs come together, up to about `rows` rows or `size` bytes; a longer run comes by itself.
    """
    held: list[pa.RecordBatch] = []
    n, most = 0, 1.0

    def whole(last: bool):
        t = pa.Table.from_batches(held).combine_chunks()
        keys = [t.column(i).to_numpy() for i in range(width)]
        starts = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))
        return (t, starts, t.num_rows) if last else (t, starts, int(starts[-1]))

    for b in batches:
        if b.num_rows:
            held.append(b)
            n = max(sum(x.num_rows for x in held) / rows, sum(x.nbytes for x in held) / size)
            if n >= most:
                t, starts, cut = whole(False)
                if cut:
                    yield t.slice(0, cut).combine_chunks(), starts[:-1]
                held, most = t.slice(cut).combine_chunks().to_batches(), 1.0 if cut else 2 * n
    if held:
        t, starts, _ = whole(True)
        yield t, starts


def binary_rows(column) -> np.ndarray:
    """Binary values of one length as the rows of a matrix of bytes."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = values.chunk(0) if isinstance(values, pa.ChunkedArray) else values
    return np.frombuffer(b"".join(values.to_pylist()), np.uint8).reshape(len(values), -1)
