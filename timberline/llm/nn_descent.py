"""Approximate nearest neighbours by NN-descent.

Equal vectors are one class. Each round joins every class's neighbours with each other through Spark joins (the
neighbours of a class, forward and back, meet at that class) and keeps the closest `k` for each; rounds stop when few
lists change. The first lists come from several random projections, where each class takes the next classes in
sorted order within its block. Queries start at their own neighbours and a few fixed classes and walk the graph: each
step opens the classes not yet opened among the best `beam`, measures their neighbours, and keeps the best `beam`,
until nothing new is found. A graph of `held_bytes` at most, by counts of its rows, is sent to the tasks whole and they walk it;
the steps of a larger one are Spark joins. Both take the same steps. Graph and walk measure single-precision components with a scale of each vector's
own, so no other vector changes a vector's resolution; what the walk found is measured again on the original vectors in
double precision.

Edge cases: vectors that are null, empty, zero, of another length than most or with null or non-finite components take
no part; equal vectors are all returned, ties by smaller id; of repeated rows of one id the smallest vector counts;
with fewer candidates than asked all that are found are returned; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import itertools
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_key, dropped, written


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v (array of double): the vectors that take part."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(good)
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1)
    rows = rows.join(F.broadcast(lengths.select("d")), F.size("v") == F.col("d"), "left_semi")
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def _single(v: np.ndarray) -> bytes:
    """A vector as its own scale, a power of two, and single-precision components."""
    scale = 2.0 ** min(1000, max(-1000, int(np.frexp(np.abs(v).max())[1])))
    return np.float64(scale).tobytes() + (v / scale).astype(np.float32).tobytes()


def _packed(v, kind: type = np.float32) -> np.ndarray:
    """Packed vectors as the rows of a matrix of doubles."""
    if kind is np.float64:
        return np.frombuffer(b"".join(v), kind).reshape(len(v), -1)
    return _unpacked(np.frombuffer(b"".join(v), np.float32).reshape(len(v), -1))


def _unpacked(x: np.ndarray) -> np.ndarray:
    """The same of rows of scales (as two numbers) and components."""
    return x[:, 2:] * np.ascontiguousarray(x[:, :2]).view(np.float64)


def _first_lists(classes: DataFrame, dims: int, k: int, tables: int, seed: int, block: int = 64) -> DataFrame:
    """node, other, d2: near classes on random projections, measured."""
    n_parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = 4
    planes = np.random.default_rng(seed).standard_normal((tables, bits + 1, dims))

    def keys(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, x = b.column(0), _packed(b.column(1).to_pylist())
            for t in range(tables):
                y = x @ planes[t].T
                sign = ((y[:, :bits] > 0) << np.arange(bits)).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(sign.astype(np.int32)), pa.array(y[:, bits].astype(np.float64)), node, b.column(1)], ["t", "cell", "at", "node", "x"])

    def near(batches) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def links(rows):
            x, ids = _packed([r[4] for r in rows]), np.array([r[3] for r in rows])
            d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1) if len(x) <= 2 * block else None
            np.fill_diagonal(d, np.inf)
            take = min(k, len(ids) - 1)
            if take > 0:
                best = np.argpartition(d, take - 1, axis=1)[:, :take]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, take)), pa.array(ids[best].ravel()), pa.array(np.take_along_axis(d, best, 1).ravel().astype(np.float64))], ["node", "other", "d2"])

        for b in batches:
            held += zip(*(c.to_pylist() for c in b.columns))
            while len(held) >= 2 * block:
                same = [r for r in held[:block] if r[:2] == held[0][:2]]
                yield from links(same)
                held = held[len(same) :]
        while held:
            same = [r for r in held[:block] if r[:2] == held[0][:2]]
            yield from links(same)
            held = held[len(same) :]

    cells = classes.mapInArrow(keys, "t int, cell int, at double, node long, x binary")
    ordered = cells.repartitionByRange(n_parts, "t", "cell", "at").sortWithinPartitions("t", "cell", "at", "node")
    return ordered.mapInArrow(near, "node long, other long, d2 double")


_LISTS = "node long, other long, d2 double, new int, pick int, worst double"


def _mixed(a: int, b: int, seed: int) -> int:
    """A lot for a pair, the same on every machine."""
    x = ((a * 0x9E3779B97F4A7C15) ^ (b * 0xC2B2AE3D27D4EB4F) ^ (seed * 0x165667B19E3779F9)) & 0xFFFFFFFFFFFFFFFF
    return ((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF


def _closest(pairs: DataFrame, k: int, sample: int = 0, seed: int = 0) -> DataFrame:
    """The k closest of each node: one row each, near first. Rows come sorted, so a task holds k of one node at a time.

    pick: 1 for `sample` of a node's rows, new ones first, by lot; worst: the distance of the k-th, if there are so many.
    """

    def first(batches) -> Iterator[pa.RecordBatch]:
        def leave(node: int, rows: list[tuple]) -> list[tuple]:
            chosen = {r[0] for r in sorted(rows, key=lambda r: (-r[2], _mixed(node, r[0], seed)))[:sample]}
            worst = rows[-1][1] if len(rows) >= k else float("inf")
            return [(node, o, d, n, int(o in chosen), worst) for o, d, n in rows]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], ["node", "other", "d2", "new", "pick", "worst"])

        now, seen, rows, out = None, set(), [], []
        for b in batches:
            for node, other, d2, new in zip(*(c.to_pylist() for c in b.columns)):
                if node != now:
                    if rows:
                        out += leave(now, rows)
                    now, seen, rows = node, set(), []
                if len(seen) < k and other not in seen:
                    seen.add(other)
                    rows.append((other, d2, new))
            if len(out) >= 10_000:
                yield batch(out)
                out = []
        if rows:
            out += leave(now, rows)
        if out:
            yield batch(out)

    return pairs.select("node", "other", "d2", "new").repartition("node").sortWithinPartitions("node", "d2", "other", "new").mapInArrow(first, _LISTS)


def graph(classes: DataFrame, dims: int, k: int = 20, rounds: int = 6, sample: int = 12, tables: int = 8, seed: int = 7, settle: float = 0.02) -> DataFrame:
    """node, other, d2: the neighbour graph. classes: node, x (of _single).

    sample: new neighbours of each node that a round joins, forward and as many back; the others wait for the next.
    new: 0 for a neighbour that has been joined, 1 for one that hasn't.
    """
    lists = written(_closest(_first_lists(classes, dims, k, tables, seed).withColumn("new", F.lit(1)), k, sample, seed), "lists")
    n = classes.count()

    def meet(batches) -> Iterator[pa.RecordBatch]:
        def run(key, rows):
            at = {}
            for other, new, x, worst in rows:
                at[other] = max(new, at[other][0]) if other in at else new, x, worst
            ids = np.array(list(at))
            new = np.array([v[0] for v in at.values()], bool)
            if len(ids) < 2 or not new.any():
                return
            x = _packed([v[1] for v in at.values()])
            sq = (x**2).sum(1)
            d = np.maximum(0, sq[:, None] + sq[None, :] - 2 * x @ x.T)
            d[~(new[:, None] | new[None, :])] = np.inf  # old neighbours have met already
            np.fill_diagonal(d, np.inf)
            take = min(k // 2, len(ids) - 1)
            best = np.argpartition(d, take - 1, axis=1)[:, :take]
            who, where = np.repeat(np.arange(len(ids)), take), best.ravel()
            ok = d[who, where] < np.array([v[2] for v in at.values()])[who]  # nearer than the node's furthest
            who, where = who[ok], where[ok]
            if len(who):
                yield pa.RecordBatch.from_arrays([pa.array(ids[who]), pa.array(ids[where]), pa.array(d[who, where].astype(np.float64)), pa.array(np.ones(len(who), np.int32))], ["node", "other", "d2", "new"])

        yield from by_key(batches, 1, run)

    for turn in range(rounds):
        chosen = lists.where("pick = 1").select("node", "other", "new")
        back = chosen.select(F.col("other").alias("node"), F.col("node").alias("other"), "new")
        back = back.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("new"), F.xxhash64(F.lit(seed - turn), "node", "other")))).where(f"r <= {sample}")
        around = chosen.select("node", "other", "new").unionByName(back.select("node", "other", "new"))
        worst = lists.groupBy("node").agg(F.max("worst").alias("worst"))
        about = classes.join(worst, "node", "left").select(F.col("node").alias("other"), "x", F.coalesce("worst", F.lit(float("inf"))).alias("worst"))
        found = around.join(about, "other").select("node", "other", "new", "x", "worst").repartition("node").sortWithinPartitions("node").mapInArrow(meet, "node long, other long, d2 double, new int")
        old = lists.select("node", "other", "d2", F.when(F.col("pick") == 1, 0).otherwise(F.col("new")).alias("new"))
        after = written(_closest(old.unionByName(found), k, sample, seed + turn + 1), "lists")
        fresh = after.agg(F.sum("new")).first()[0] or 0
        unjoined = old.agg(F.sum("new")).first()[0] or 0
        dropped(classes.sparkSession, lists)
        lists = after
        if fresh - unjoined < settle * n * k:
            break
    return lists.select("node", "other", "d2")


def _walker(edges: DataFrame, classes: DataFrame, opening: np.ndarray, beam: int):
    """What walks the whole graph in a task, for rows of asked: node, other, d2 of the best `beam` of each."""
    rows = classes.toArrow()
    node = rows.column("node").to_numpy()
    order = np.argsort(node)
    node, single = node[order], np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float32).reshape(len(node), -1)[order]
    links = edges.select("node", "other").toArrow()
    at, to = (np.searchsorted(node, links.column(c).to_numpy()).astype(np.int32) for c in ("node", "other"))
    to = to[np.argsort(at, kind="stable")]
    starts = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(node)))])
    graph = classes.sparkSession.sparkContext.broadcast((node, starts, to, single, np.searchsorted(node, opening)))

    def walk(batches) -> Iterator[pa.RecordBatch]:
        node, starts, to, single, opening = graph.value
        for b in batches:
            for q, qx in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                v, own, met = _packed([qx]), int(np.searchsorted(node, q)), np.zeros(len(node), bool)
                place, d2 = np.zeros(0, np.int64), np.zeros(0)
                met[opening] = True
                reached = np.union1d(opening, [i for i in to[starts[own] : starts[own + 1]] if i != own]).astype(np.int64)
                while len(reached):
                    met[reached] = True
                    new = np.arange(len(place) + len(reached)) >= len(place)
                    place, d2 = np.concatenate([place, reached]), np.concatenate([d2, ((v - _unpacked(single[reached])) ** 2).sum(1)])
                    best = np.lexsort((node[place], d2))[:beam]
                    place, d2, new = place[best], d2[best], new[best]
                    reached = np.unique(np.concatenate([to[starts[i] : starts[i + 1]] for i in place[new]] or [to[:0]])).astype(np.int64)
                    reached = reached[~met[reached] & (reached != own)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), q)), pa.array(node[place]), pa.array(d2)], ["node", "other", "d2"])

    return walk


def search(vectors: DataFrame, queries: DataFrame | None = None, every: int = 100, top: int = 10, k: int = 24, beam: int = 200, starts: int = 24, steps: int | None = None, broadcast_rows: int = 500_000, held_bytes: int = 64 << 20, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding", **how) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the `top` nearest others found.

    queries: a table with the ids of the vectors to ask for; without it those whose id is divisible by `every`. A walk ends when
    none of the best `beam` is unopened. steps: of a graph walked by joins, the most, with a warning; None: as many as it takes.
    """
    spark = vectors.sparkSession
    rows = written(usable(vectors, id_col, vector_col), "vectors")
    first = rows.select(F.size("v")).first()
    if first is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = first[0]

    def pack(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [np.array(v, np.float64) for v in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v.tobytes() for v in x], pa.binary()), pa.array([_single(v) for v in x], pa.binary())], ["id", "whole", "x"])

    packed = rows.select("id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v")).mapInArrow(pack, "id long, whole binary, x binary")
    member = written(packed.join(packed.groupBy("whole").agg(F.min("id").alias("node")), "whole").select("id", "node", "whole", "x"), "member")
    classes = written(member.where("id = node").select("node", "x"), "classes")
    edges = graph(classes, dims, k, seed=seed, **how)
    back = edges.select(F.col("other").alias("node"), F.col("node").alias("other"), "d2")
    kept_back = back.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("d2", "other"))).where(f"r <= {k}").select("node", "other")
    around = edges.select("node", "other").unionByName(kept_back).distinct()

    if queries is None:
        asking = member.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "node")
    else:
        wanted = queries.select(F.col(id_col).cast("long").alias("query_id")).distinct()
        asking = member.join(wanted, member["id"] == wanted["query_id"]).select("query_id", "node")
    asked_ids = asking.select(F.col("node").alias("q")).distinct()
    asked = written(asked_ids.join(classes, asked_ids["q"] == classes["node"]).select("q", F.col("x").alias("qx")), "asked")
    opening = classes.orderBy(F.xxhash64(F.lit(seed), "node"), "node").limit(starts).collect()  # a fixed number
    schema = "node long, other long, d2 double, new int"

    def measure(kind: type):
        def run(batches) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    q, x = _packed(b.column(2).to_pylist(), kind), _packed(b.column(3).to_pylist(), kind)
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(((q - x) ** 2).sum(1).astype(np.float64)), pa.array(np.ones(b.num_rows, np.int32))], ["node", "other", "d2", "new"])

        return run

    def joined() -> DataFrame:
        """The walks by joins, a few for each step."""
        both = written(around.join(classes.select(F.col("node").alias("other"), "x"), "other").select("node", "other", "x"), "graph")

        def begin(batches) -> Iterator[pa.RecordBatch]:
            at, x = np.array([r.node for r in opening]), _packed([bytes(r.x) for r in opening])
            for b in batches:
                for q, qx in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    n = len(at)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, q)), pa.array(at), pa.array(((_packed([qx]) - x) ** 2).sum(1).astype(np.float64)), pa.array(np.ones(n, np.int32))], ["node", "other", "d2", "new"])

        n_asked = asked.count()
        near_asked = F.broadcast(asked) if n_asked * beam <= broadcast_rows else asked

        def walked(open_: DataFrame) -> DataFrame:
            """The graph's neighbours of (q, via), measured. A step's places to open are few unless the queries are many."""
            few = F.broadcast(open_) if n_asked * beam <= broadcast_rows else open_
            reached = both.join(few, both["node"] == few["via"]).select("q", "other", "x").where("q != other")
            return reached.join(near_asked, "q").select(F.col("q").alias("node"), "other", "qx", "x").mapInArrow(measure(np.float32), schema)

        own = walked(asked.select("q", F.col("q").alias("via")))
        found = written(_closest(asked.mapInArrow(begin, schema).unionByName(own), beam), "found")
        for step in itertools.count():
            open_ = found.where("new = 1").select(F.col("node").alias("q"), F.col("other").alias("via"))
            if open_.isEmpty():
                break
            if step == steps:
                warnings.warn(f"walks were ended after {steps} steps", stacklevel=2)
                break
            after = written(_closest(found.select("node", "other", "d2", F.lit(0).alias("new")).unionByName(walked(open_)), beam), "found")
            dropped(spark, found)
            found = after
        dropped(spark, both)
        return found

    # A class has 2k links at most.
    if classes.count() * (8 + 4 * (dims + 2) + 2 * k * 4) <= held_bytes:
        walk = _walker(around, classes, np.array([r.node for r in opening]), beam)
        found = written(asked.mapInArrow(walk, "node long, other long, d2 double"), "found")
    else:
        found = joined()
    whole = member.where("id = node").select("node", "whole")
    exact = found.where("node != other").join(whole.select(F.col("node").alias("other"), F.col("whole").alias("w")), "other").join(whole, "node")
    near_by = exact.select("node", "other", "whole", "w").mapInArrow(measure(np.float64), schema)
    # Every member of a class is as near as the class; the smallest ids of each are enough.
    few = member.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("id"))).where(f"r <= {top + 1}").select(F.col("node").alias("other"), "id")
    same = asking.select("node", F.col("node").alias("other"), F.lit(0.0).alias("d2")).distinct()
    near = near_by.select("node", "other", "d2").unionByName(same)
    best = near.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("d2", "other"))).where(f"r <= {top + 1}")
    wide = asking.join(best, "node").join(few, "other").where("id != query_id")
    ranked = wide.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("d2", "id"))).where(f"rank <= {top}")
    return ranked.select("query_id", "rank", F.col("id").alias("vec_id"), F.sqrt("d2").alias("score"))
