"""Training rows in blocks: a row of the table holds some ten thousand rows of the fit, each column packed.

A job over blocks hands whole arrays to Python without taking rows apart, and gives back a few packed arrays. Sums of
many tasks are added by Spark, part by part, before they reach the driver; so are counts when an order statistic is
looked for, which takes a fixed number of digits at a time and never sorts the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "row binary, y binary, w binary, raw binary, bins binary"
#: How many tasks may send their sums straight to the driver.
DIRECT = 32


@dataclass
class Block:
    """raw: rows x outputs; bins: rows x features, stored feature by feature."""

    row: np.ndarray
    y: np.ndarray
    w: np.ndarray
    raw: np.ndarray
    bins: np.ndarray

    @staticmethod
    def of(batch) -> "Iterator[Block]":
        for i in range(batch.num_rows):
            row, y, w, raw, bins = (np.frombuffer(batch.column(j)[i].as_buffer(), kind) for j, kind in enumerate((np.int64, np.float64, np.float64, np.float64, np.uint16)))
            yield Block(row, y, w, raw.reshape(-1, len(row)).T, bins.reshape(-1, len(row)).T)


def packed(df: DataFrame, width: int, size: int = 1 << 16) -> DataFrame:
    """df: row long, y, w, `width` raw scores as doubles, then bins as ints."""

    def run(batches):
        import pyarrow as pa

        held, n = [], 0

        def block():
            t = pa.Table.from_batches(held)
            cols = [c.to_numpy() for c in t.columns]
            parts = [cols[0].astype(np.int64), cols[1].astype(float), cols[2].astype(float), np.concatenate([c.astype(float) for c in cols[3 : 3 + width]]), np.concatenate([c.astype(np.uint16) for c in cols[3 + width :]])]
            return pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], ["row", "y", "w", "raw", "bins"])

        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
                if n >= size:
                    yield block()
                    held, n = [], 0
        if held:
            yield block()

    return df.mapInArrow(run, SCHEMA)


def with_raw(blocks: DataFrame, change: Callable[[Block], np.ndarray]) -> DataFrame:
    """The blocks with other raw scores."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            raws = [np.ascontiguousarray(change(x).T).tobytes() for x in Block.of(b)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(raws, pa.binary()), b.column(4)], b.schema.names)

    return blocks.mapInArrow(run, SCHEMA)


def summed(blocks: DataFrame, tasks: int, parts: list[int], add: Callable[[list[np.ndarray], Block], None]) -> list[np.ndarray]:
    """Sums of arrays of doubles, `parts` long, over all blocks; add() adds a block's share to a task's arrays."""

    def run(batches):
        import pyarrow as pa

        sums = [np.zeros(n) for n in parts]
        for b in batches:
            for x in Block.of(b):
                add(sums, x)
        used = [k for k, s in enumerate(sums) if s.any()]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([sums[k].tobytes() for k in used], pa.binary())], ["part", "data"])

    def gather(batches):
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, d in zip(b.column(0).to_pylist(), b.column(1)):
                x = np.frombuffer(d.as_buffer())
                sums[k] = sums[k] + x if k in sums else x
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["part", "data"])

    found = blocks.mapInArrow(run, "part int, data binary")
    if tasks > DIRECT:
        found = found.repartition(min(len(parts), tasks), "part").mapInArrow(gather, "part int, data binary")
    out = [np.zeros(n) for n in parts]
    for r in found.collect():
        out[r.part] += np.frombuffer(r.data)
    return out


def rows_of(blocks: DataFrame, schema: str, make: Callable[[Block], dict[str, np.ndarray]]) -> DataFrame:
    """One row for each row of the blocks again, of the columns that make() gives."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for x in Block.of(b):
                cols = make(x)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols.values()], list(cols))

    return blocks.mapInArrow(run, schema)


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Doubles as unsigned numbers in the same order; -0.0 as 0.0."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))


def values_of(bits: np.ndarray) -> np.ndarray:
    bits = np.asarray(bits, np.uint64)
    return np.where(bits >> np.uint64(63) == 1, bits & np.uint64((1 << 63) - 1), ~bits).view(np.float64)


def _narrowed(blocks: DataFrame, tasks: int, groups: int, keys: Callable, place: Callable, few: int) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray]:
    """For each group the prefix (bits, value) of the keys among which the wanted place lies, once they are few or equal.

    keys(block) gives (group, key, weight) of its rows; place(totals) the weight that must come before or at the place.
    Returns what comes before the prefix's keys, the prefixes, and the groups' totals.
    """
    prefix, bits, digit = np.zeros(groups, np.uint64), 0, 12 if groups <= 64 else 8
    before, want, totals, left = np.zeros(groups), None, None, np.full(groups, np.inf)
    while bits < 64:
        step = min(digit, 64 - bits)
        shift, cells = np.uint64(64 - bits - step), 1 << step

        def add(sums, b):
            g, k, w = keys(b)
            if bits:
                ok = (k >> np.uint64(64 - bits)) == prefix[g]  # noqa: B023
                g, k, w = g[ok], k[ok], w[ok]
            at = g * cells + ((k >> shift) & np.uint64(cells - 1)).astype(np.int64)  # noqa: B023
            sums[0] += np.bincount(at, w, groups * cells)  # noqa: B023
            sums[1] += np.bincount(at, minlength=groups * cells)  # noqa: B023

        w, n = (x.reshape(groups, cells) for x in summed(blocks, tasks, [groups * cells] * 2, add))
        if want is None:
            totals = w.sum(1)
            want = place(totals)
        run = before[:, None] + np.cumsum(w, axis=1)
        over = (run > want[:, None]) & (n > 0)
        pick = np.where(over.any(1), over.argmax(1), np.where(n.any(1), cells - 1 - (n[:, ::-1] > 0).argmax(1), 0))
        each = np.arange(groups)
        before = before + np.where(pick > 0, np.cumsum(w, axis=1)[each, np.maximum(pick - 1, 0)], 0.0)
        prefix = (prefix << np.uint64(step)) | pick.astype(np.uint64)
        bits, left = bits + step, n[each, pick]
        if left.sum() <= few:
            break
    return before, [(bits, int(p)) for p in prefix], totals


def kth(blocks: DataFrame, tasks: int, keys: Callable[[Block], np.ndarray], k: int, few: int = 4096) -> tuple[int, int]:
    """The k-th (from 1) of all rows in the order (key, row id): its key and row id. keys: unsigned 64-bit numbers.

    Where a key is allowed but not all rows have one, keys() gives a masked array.
    """

    def of(b):
        key = keys(b)
        ok = ~np.ma.getmaskarray(key)
        return np.zeros(int(ok.sum()), np.int64), np.ma.getdata(key)[ok], np.ones(int(ok.sum()))

    before, [(bits, p)], _ = _narrowed(blocks, tasks, 1, of, lambda t: np.array([k - 1.0]), few)
    here = lambda key: (key >> np.uint64(64 - bits)) == np.uint64(p)

    def within(b):
        key = keys(b)
        ok = ~np.ma.getmaskarray(key) & here(np.ma.getdata(key))
        return b.row[ok], np.ma.getdata(key)[ok]

    if bits < 64:

        def pairs(b):
            row, key = within(b)
            return {"row": row, "key": key.view(np.int64)}

        found = rows_of(blocks, "row long, key long", pairs).toArrow()
        row, key = found.column("row").to_numpy(), found.column("key").to_numpy().view(np.uint64)
        i = np.lexsort((row, key))[int(k - 1 - before[0])]
        return int(key[i]), int(row[i])

    def ids(b):  # all have one key: the row ids decide
        row, _ = within(b)
        return np.zeros(len(row), np.int64), row.astype(np.uint64) ^ np.uint64(1 << 63), np.ones(len(row))

    _, [(id_bits, q)], _ = _narrowed(blocks, tasks, 1, ids, lambda t: np.array([k - 1.0 - before[0]]), 1)
    if id_bits < 64:
        got = rows_of(blocks, "row long", lambda b: {"row": (r := within(b)[0])[((r.astype(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(64 - id_bits)) == np.uint64(q)]}).toArrow()
        return p, int(got.column("row").to_numpy()[0])
    return p, int(np.uint64(q) ^ np.uint64(1 << 63))


def group_percentiles(blocks: DataFrame, tasks: int, groups: int, values: Callable[[Block], tuple[np.ndarray, np.ndarray]], alpha: float, weighted: bool, few: int = 65_536) -> np.ndarray:
    """For each group the alpha percentile of its values; values(block) gives (group, value). nan for an empty group.

    Unweighted: linear between the two neighbours of rank (n - 1) * alpha. Weighted: the first row, by value then row id, at
    which the running weight passes alpha times the total, interpolated from the row before only where its weight is 1 or more.
    """

    def keys(b):
        g, v = values(b)
        use = (g >= 0) & (b.w > 0)
        return g[use], ordered_bits(v[use]), b.w[use] if weighted else np.ones(int(use.sum()))

    place = (lambda t: t * alpha) if weighted else (lambda t: np.maximum(np.floor((t - 1) * alpha), 0.0))
    before, prefix, totals = _narrowed(blocks, tasks, groups, keys, place, few)
    bits, p = prefix[0][0], np.array([x for _, x in prefix], np.uint64)

    def near(b):
        """Of each group in the block: all rows of the prefix, the largest below and the smallest above."""
        g, v = values(b)
        use = (g >= 0) & (b.w > 0)
        g, v, w, row = g[use], v[use], b.w[use], b.row[use]
        head = ordered_bits(v) >> np.uint64(64 - bits)
        inside = head == p[g]
        low, high = np.full(groups, -np.inf), np.full(groups, np.inf)
        np.maximum.at(low, g[head < p[g]], v[head < p[g]])
        np.minimum.at(high, g[head > p[g]], v[head > p[g]])
        lows, highs = np.flatnonzero(np.isfinite(low)), np.flatnonzero(np.isfinite(high))
        kind = np.concatenate([np.zeros(int(inside.sum()), np.int32), np.full(len(lows), -1, np.int32), np.full(len(highs), 1, np.int32)])
        return {"g": np.concatenate([g[inside], lows, highs]).astype(np.int64), "kind": kind, "v": np.concatenate([v[inside], low[lows], high[highs]]), "w": np.concatenate([w[inside], np.zeros(len(lows) + len(highs))]), "row": np.concatenate([row[inside], np.zeros(len(lows) + len(highs), np.int64)])}

    found = rows_of(blocks, "g long, kind int, v double, w double, row long", near)
    # Of equal values only how many there are and the first row's weight matter.
    t = found.groupBy("g", "kind", "v").agg(F.sum("w").alias("w"), F.min_by("w", "row").alias("first"), F.count("*").alias("n")).toArrow()
    g, kind, v, w, one, n = (t.column(c).to_numpy() for c in ("g", "kind", "v", "w", "first", "n"))
    out = np.full(groups, np.nan)
    for i in range(groups):
        own = (g == i) & (kind == 0)
        if not own.any():
            continue
        order = np.argsort(v[own])
        x, ws, ones, ns = v[own][order], w[own][order], one[own][order], n[own][order]
        below = v[(g == i) & (kind < 0)].max(initial=-np.inf)
        above = v[(g == i) & (kind > 0)].min(initial=np.inf)
        if weighted:
            at = totals[i] * alpha
            run = before[i] + np.cumsum(ws)
            j = int((run > at).argmax()) if (run > at).any() else len(x) - 1
            start = run[j] - ws[j]
            lower = x[j - 1] if j else below
            last = j == len(x) - 1 and not np.isfinite(above) and ns[j] == 1
            first_row = at < start + ones[j]
            if not first_row or last or not np.isfinite(lower):
                out[i] = x[j]
            else:
                out[i] = (at - start) / ones[j] * (x[j] - lower) + lower if ones[j] >= 1 else lower
        else:
            rank = (totals[i] - 1) * alpha
            run = before[i] + np.cumsum(ns)
            j = int((run > np.floor(rank)).argmax())
            nxt = x[j] if np.floor(rank) + 1 < run[j] else x[j + 1] if j + 1 < len(x) else above
            part = rank - np.floor(rank)
            out[i] = x[j] + part * (nxt - x[j]) if part and np.isfinite(nxt) else x[j]
    return out
