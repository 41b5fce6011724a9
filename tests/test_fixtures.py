"""Pinned values and properties."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.functions import losses, metrics
from timberline.operators import binning, order, profile, rows, splits, targets
from timberline.plans import boost, explain, linear, model, search
from timberline.sources import tables


def value(df):
    return df.first()["value"]


SCORES, LABELS = [0.9, 0.8, 0.8, 0.7, 0.6, 0.6, 0.6, 0.3, 0.2, 0.1], [1, 1, 0, 1, 0, 1, 0, 0, 1, 0]
WEIGHTS = [1, 0.5, 2, 1.5, 1, 0.25, 3, 1, 0.5, 2]


@pytest.fixture(scope="module")
def scored(spark):
    return spark.createDataFrame([(s, float(y), float(w)) for s, y, w in zip(SCORES, LABELS, WEIGHTS)], "s double, y double, w double").cache()


def test_ranking_metrics(scored):
    assert value(metrics.aucpr(scored, "s", "y")) == pytest.approx(0.7087301587301587, abs=1e-12)
    assert value(metrics.aucpr(scored, "s", "y", "w")) == pytest.approx(0.633744575139924, abs=1e-12)
    assert value(metrics.auc(scored, "s", "y")) == pytest.approx(0.7)


def test_auc_ends(spark):
    d = spark.createDataFrame([(1.0, 0.0, 0.5), (2.0, 1.0, 0.5), (3.0, 1.0, 0.5)], "s double, y double, c double")
    assert value(metrics.auc(d, "s", "y")) == 1
    assert value(metrics.auc(d, "c", "y")) == 0.5
    assert value(metrics.auc(d.withColumn("s", -F.col("s")), "s", "y")) == 0
    assert value(metrics.auc(d.where("y = 1"), "s", "y")) == 0.5


def test_r2(spark):
    d = spark.createDataFrame([(1.0, 1.5, 1.0), (2.5, 2.0, 2.0), (2.0, 2.5, 0.5), (4.0, 3.0, 1.0), (3.5, 4.5, 3.0), (0.5, 1.0, 0.25)], "p double, y double, w double")
    assert value(metrics.r2(d, "p", "y")) == pytest.approx(0.6108108108108108)
    assert value(metrics.r2(d, "p", "y", "w")) == pytest.approx(0.5925124792013311)
    same = spark.createDataFrame([(2.0, 2.0), (2.0, 2.0)], "p double, y double")
    assert value(metrics.r2(same, "p", "y")) == 1
    assert value(metrics.r2(same.withColumn("p", F.col("p") + 1), "p", "y")) == 0


def test_raw_scores(spark):
    d = spark.createDataFrame([(-2.0, 0.0), (0.5, 1.0), (1.5, 1.0), (-0.25, 1.0), (3.0, 1.0), (-1.0, 0.0)], "s double, y double")
    assert value(metrics.error_rate(d, "s", "y", raw=True)) == pytest.approx(1 / 6)
    m = spark.createDataFrame([([2.0, 0.0, -1.0], 0), ([0.5, 0.5, 3.0], 2), ([-2.0, 1.0, 0.0], 1)], "s array<double>, y int")
    assert value(metrics.accuracy(m, "s", "y")) == 1
    assert value(metrics.accuracy(spark.createDataFrame([([1.0, 1.0], 1)], "s array<double>, y int"), "s", "y")) == 0


def test_log_factorial(spark):
    got = spark.range(0, 60).select(metrics.log_factorial(F.col("id").cast("double")).alias("v")).collect()
    assert [r.v for r in got] == pytest.approx([math.lgamma(i + 1) for i in range(60)], abs=1e-10)


def test_weighted_percentile(spark):
    d = spark.createDataFrame([(9.0, 1.0), (1.0, 1.0), (5.0, 4.0), (3.0, 1.0), (7.0, 1.0)], "v double, w double")
    assert value(order.weighted_percentile(d, "v", "w", 0.5)) == pytest.approx(4)
    d = spark.createDataFrame([(1.0, 0.2), (2.0, 0.3), (3.0, 0.3), (4.0, 0.2)], "v double, w double")
    assert value(order.weighted_percentile(d, "v", "w", 0.6)) == 2


def test_positions(spark):
    d = spark.range(1000).withColumn("k", (F.col("id") * 37) % 11)
    got = order.positions(d, [F.col("k")], ["id"]).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(1000))
    assert [(r.k, r.id) for r in got] == sorted((i * 37 % 11, i) for i in range(1000))


# Bins


def runs(values):
    v, n = np.unique(np.array(values, float), return_counts=True)
    return v, n


@pytest.mark.parametrize(
    ("values", "policy", "budget", "floor", "edges"),
    [
        ([0] + [1 + i % 5 for i in range(1, 1000)], "quantile", 255, 1, [0.5, 1.5, 2.5, 3.5, 4.5]),
        ([0, 0, 1, 1, 1, 2, 2, 2], "quantile", 255, 3, [1.5]),
        ([0, 10, 10, 20], "quantile", 255, 1, [5, 15]),
        ([k for k in range(30) for _ in range(k * k % 7 + 1)], "logsum", 2, 1, [14.5]),
        ([k for k in range(30) for _ in range(k * k % 7 + 1)], "logsum", 5, 1, [6.5, 14.5, 21.5, 24.5]),
        ([k for k in range(30) for _ in range(k * k % 7 + 1)], "logsum", 8, 1, [3.5, 6.5, 10.5, 14.5, 17.5, 21.5, 24.5]),
        ([k for k in range(30) for _ in range(k * k % 7 + 1)], "logsum", 9, 1, [3.5, 6.5, 10.5, 14.5, 17.5, 21.5, 24.5, 26.5]),
    ],
)
def test_edges(values, policy, budget, floor, edges):
    assert binning.edges_of(*runs(values), binning.BinParams(policy, floor, budget + 1)) == edges


@pytest.mark.parametrize(
    ("bins", "starts"),
    [
        (16, [1, 4, 7, 12, 17, 22, 29, 35, 41, 48, 57, 64, 72, 82, 91]),
        (32, [1, 2, 3, 4, 5, 7, 9, 12, 14, 17, 19, 22, 25, 29, 32, 35, 38, 41, 45, 48, 53, 57, 61, 64, 68, 72, 78, 82, 86, 91, 95]),
    ],
)
def test_quantile_starts(bins, starts):
    x = [37 * i % 101 for i in range(300)]
    v, n = runs([int(int(k**1.5) / 10) for k in x])
    edges = binning.edges_of(v, n, binning.BinParams("quantile", 1, bins + 1))
    assert [float(v[np.searchsorted(v, e, side="right")]) for e in edges] == starts


def test_greedy_keeps_zero_alone():
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(0, 50, 5000), 1)
    x[rng.random(5000) < 0.02] = 0.0
    x[(np.abs(x) < 0.05)] = 0.0
    for budget in (3, 16, 255):
        v, n = runs(x)
        edges = binning.edges_of(v, n, binning.BinParams("greedy", 1, budget + 1))
        b = np.searchsorted(edges, v, side="left")
        assert sum(b == b[list(v).index(0.0)]) == 1
        assert len(edges) <= budget


@pytest.mark.parametrize(("values", "cuts"), [(range(-50, 51), 19), ([*range(-50, 0), *range(1, 51)], 18), (range(1, 101), 18), (range(-100, 0), 18)])
def test_greedy_budget(values, cuts):
    """Of 20 bins one is zero's, whether or not there are zeros; the cuts around it come with its bin."""
    edges = binning.edges_of(*runs(list(values)), binning.BinParams("greedy", 1, 21))
    assert len(edges) == cuts


def test_edges_are_inclusive(spark):
    d = spark.createDataFrame([(1.0,), (1.5,), (2.0,), (None,)], "v double")
    got = [r.b for r in d.select(binning.bin_of(F.col("v"), [1.5]).alias("b")).collect()]
    assert got == [1, 1, 2, 0]


def test_schema(spark):
    d = spark.createDataFrame([(0, "red", 1.0), (1, "blue", 2.0), (2, "red", 3.0), (3, "green", None)], "row_id long, c string, v double")
    s = binning.fit_schema(d, {"c": "categorical", "v": "numeric"}, binning.BinParams(min_data_in_bin=1))
    assert s.features[0].levels == ["red", "blue", "green"]
    assert binning.BinSchema.from_json(s.to_json()) == s
    new = spark.createDataFrame([("green", 9.0), ("blue", 1.0), ("mauve", None)], "c string, v double")
    assert [(r.b_c, r.b_v) for r in binning.apply_schema(new, s).collect()] == [(3, 3), (2, 1), (0, 0)]
    with pytest.raises(ValueError, match="no column v"):
        binning.apply_schema(new.drop("v"), s)
    with pytest.raises(ValueError, match=r"c \(3\)"):
        binning.fit_schema(d, {"c": "categorical"}, binning.BinParams(max_cat_levels=2))


# Reading


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('frontage,poolqc,note\n65,Ex,"a, ""b"""\nNA,NA,"two\nlines"\n80,Gd,3" pipe\n\nNA,NA,x\n')
    f = tables.read_csv(spark, str(tmp_path / "a.csv"))
    assert f.kinds == {"frontage": "numeric", "poolqc": "categorical", "note": "categorical"}
    got = f.df.orderBy("row_id").collect()
    assert [r.frontage for r in got] == [65.0, None, 80.0, None]
    assert [r.poolqc for r in got] == ["Ex", "NA", "Gd", "NA"]
    assert got[0].note == 'a, "b"'


def test_csv_shape(spark, tmp_path):
    (tmp_path / "long.csv").write_text("a,b\n1,2\n3,4,5\n")
    with pytest.raises(ValueError, match="more than 2"):
        tables.read_csv(spark, str(tmp_path / "long.csv"))
    (tmp_path / "short.csv").write_text("a,b\n1,2\n3\n")
    f = tables.read_csv(spark, str(tmp_path / "short.csv"))
    assert f.notes["short_rows"] == 1
    assert [(r.a, r.b) for r in f.df.orderBy("row_id").collect()] == [(1.0, 2.0), (3.0, None)]


def test_sniff_and_unparsed(spark, tmp_path):
    (tmp_path / "n.csv").write_text("n\n" + "\n".join("oops" if i == 1002 else str(i) for i in range(1005)) + "\n")
    f = tables.read_csv(spark, str(tmp_path / "n.csv"))
    assert f.kinds == {"n": "numeric"} and f.notes["unparsed:n"] == 1


def test_append(spark):
    main = tables.Frame(spark.createDataFrame([(0, 1.0, 0.5, "red", 1.0), (1, 2.0, None, "blue", 0.0)], "row_id long, id double, num double, cat string, y double"), {"id": "numeric", "num": "numeric", "cat": "categorical", "y": "numeric"})
    extra = tables.Frame(spark.createDataFrame([(0, "green", 1.0, 7.0), (1, "blue", 0.0, None)], "row_id long, cat string, y double, num double"), {"cat": "categorical", "y": "numeric", "num": "numeric"})
    both = tables.append(main, extra, {"id"}).df.orderBy("row_id").collect()
    assert [(r.row_id, r.id, r.cat, r.is_extra) for r in both] == [(0, 1.0, "red", False), (1, 2.0, "blue", False), (2, None, "green", True), (3, None, "blue", True)]
    with pytest.raises(ValueError, match="lacking"):
        tables.append(main, extra)
    with pytest.raises(ValueError, match="no column z"):
        tables.drop_columns(main.df, ["z"])


# Target statistics

LEVELS = [(i, c, y) for i, (c, y) in enumerate(zip([1, 2, 1, 1, 2, 3], [1, 0, 0, 1, 1, 0]))]


@pytest.mark.parametrize(("prior", "each", "final"), [(0.0, [0, 0, 7, 5, 0, 0], [7, 5, 0]), (0.5, [7, 7, 11, 7, 3, 7], [9, 7, 3]), (1.0, [15, 15, 15, 10, 7, 15], [11, 10, 7])])
def test_ctr(spark, prior, each, final):
    d = spark.createDataFrame(LEVELS, "i int, c int, y int")
    assert [r.b for r in d.select("i", targets.ctr_borders(d, "c", "y", ["i"], prior).alias("b")).orderBy("i").collect()] == each
    assert [r.bucket for r in targets.ctr_final(d, "c", "y", prior).orderBy("c").collect()] == final
    assert [r.bucket for r in targets.ctr_counter(d, "c").orderBy("c").collect()] == [11, 7, 3]


def test_prefixes():
    assert targets.ordered_prefixes(3000) == [(60, 120), (120, 240), (240, 480), (480, 960), (960, 1920), (1920, 3000)]
    p = targets.ordered_prefixes(10)
    assert p[0][0] == 1 and p[-1] == (8, 10)


def test_mvs(spark):
    d = spark.createDataFrame([(0, 2.0)] * 10, "b int, v double")
    assert rows.mvs_threshold(d, "b", "v", 0.4).first()["mu"] == pytest.approx(5)


# Rows


def test_folds(spark):
    d = spark.range(1000).withColumn("y", (F.col("id") % 5 == 0).cast("double"))
    assert [r["count"] for r in rows.folds(d, ["id"], 5, 1, "y").groupBy("fold").count().collect()] == [200] * 5
    pos = rows.folds(d, ["id"], 5, 1, "y").where("y = 1").groupBy("fold").count().collect()
    assert [r["count"] for r in pos] == [40] * 5
    g = d.withColumn("g", F.expr("id div 4"))
    f = rows.grouped_folds(g, "g", 5)
    assert f.groupBy("g").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    with pytest.raises(ValueError, match="too few"):
        rows.grouped_folds(g.where("g < 3"), "g", 5)
    assert rows.holdout(d, ["id"], 0.2).where("is_valid").count() == 200
    assert rows.stop_slice(d, ["id"], 1, "y").where("is_stop").count() == 100


def test_label_checks(spark):
    d = spark.createDataFrame([(0.0,), (2.0,)], "y double")
    for objective, frame in (("logistic", d), ("poisson", d.withColumn("y", -F.col("y"))), ("squared_error", d.withColumn("y", F.lit(None).cast("double")))):
        with pytest.raises(ValueError):
            rows.check_labels(frame, "y", objective)
    with pytest.raises(ValueError):
        rows.check_weights(d.withColumn("w", F.lit(0.0)), "w")


# Splits


def brute_root(bins, g, h, p):
    """The best numeric split of each (feature, threshold, side of missing), by looking at rows."""
    best = None
    G, H = g.sum(), h.sum()
    s = lambda a, b: a * a / (b + p.reg_lambda)
    for f in range(bins.shape[1]):
        b = bins[:, f]
        for t in range(b.max()):
            for ml in (True, False):
                left = np.where(b == 0, ml, b <= t)
                if min(left.sum(), (~left).sum()) < p.min_child_samples or min(h[left].sum(), h[~left].sum()) < p.min_child_weight:
                    continue
                gain = s(g[left].sum(), h[left].sum()) + s(g[~left].sum(), h[~left].sum()) - s(G, H)
                if best is None or gain > best + 1e-9:
                    best = gain
    return best


def test_split_brute_force(spark):
    rng = np.random.default_rng(0)
    bins = rng.integers(0, 9, (600, 3))
    y = ((bins[:, 0] > 4) ^ (rng.random(600) < 0.3)).astype(float)
    g, h = 0.5 - y, np.full(600, 0.25)
    want = brute_root(bins, g, h, splits.SplitParams())
    offsets = np.array([0, 10, 20, 30])
    hist = np.zeros((30, 3))
    for f in range(3):
        for j, v in enumerate((g, h, np.ones(600))):
            hist[f * 10 : f * 10 + 10, j] = np.bincount(bins[:, f], v, 10)
    got = boost.best_split(hist, offsets, ["numeric"] * 3, boost.TreeParams())
    assert -got.neg_gain == pytest.approx(want)
    d = spark.createDataFrame([(*map(int, b), float(a), float(c)) for b, a, c in zip(bins, g, h)], "a int, b int, c int, g double, h double")
    t = splits.histogram(d, ["a", "b", "c"], {"n": F.lit(1), "g": F.col("g"), "h": F.col("h")})
    best = splits.best(splits.numeric_splits(t, splits.SplitParams()), ["feature", "threshold"]).first()
    assert best["gain"] == pytest.approx(want) and best["feature"] == "abc"[got.feature] and best["threshold"] == got.threshold


def test_missing_goes_its_own_way():
    """Missing rows are positive, the others are not: the root parts them."""
    b = np.array([0 if i % 10 < 3 else 1 for i in range(1000)])
    y = np.array([float(i % 10 != 0) if i % 10 < 3 else float(i % 10 == 9) for i in range(1000)])
    hist = np.column_stack([np.bincount(b, 0.5 - y, 2), np.bincount(b, np.full(1000, 0.25), 2), np.bincount(b, minlength=2)])
    s = boost.best_split(hist, np.array([0, 2]), ["numeric"], boost.TreeParams())
    assert s.threshold == 0 and s.missing_left


# Models


@pytest.fixture(scope="module")
def learnable(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(1, 17, (4000, 4)).astype(float)
    s = (x[:, 0] > 8).astype(float) + (x[:, 1] > 12) - (x[:, 2] < 4) + 0.35 * rng.normal(size=4000)
    y = (s > 0.5).astype(float)
    data = [(i, *(float(v) if rng.random() > 0.05 else None for v in r), float(t), float(u)) for i, (r, t, u) in enumerate(zip(x, y, s))]
    return spark.createDataFrame(data, "row_id long, a double, b double, c double, d double, y double, s double").repartition(4).cache()


KINDS = {c: "numeric" for c in "abcd"}


@pytest.mark.parametrize("policy", ["depthwise", "lossguide", "symmetric"])
def test_boosting_learns(spark, learnable, policy):
    t = boost.TreeParams(policy, 4, 12 if policy == "lossguide" else 0)
    m = boost.train(learnable, KINDS, "y", boost.BoostParams(n_rounds=12, tree=t, store_every=5))
    out = model.predict(learnable, m, ["row_id", "y"])
    assert value(metrics.auc(out, "prediction", "y")) > 0.93
    again = model.Model.from_json(m.to_json())
    a, b = (p.orderBy("row_id").toPandas() for p in (out, model.predict(learnable, again, ["row_id", "y"])))
    assert a.equals(b)
    assert len(m.trees) == 12


def test_partitions_do_not_matter(spark, learnable):
    p = boost.BoostParams(n_rounds=3, tree=boost.TreeParams(max_depth=3))
    trees = [boost.train(learnable.repartition(k), KINDS, "y", p).trees for k in (1, 3, 16)]
    for other in trees[1:]:
        assert [(t.feature, t.threshold, t.missing_left) for t in other] == [(t.feature, t.threshold, t.missing_left) for t in trees[0]]


def test_weight_is_repetition(spark, learnable):
    p = boost.BoostParams(n_rounds=2, tree=boost.TreeParams(max_depth=3, split=splits.SplitParams(min_child_samples=1)), bins=binning.BinParams(min_data_in_bin=1))
    d = learnable.withColumn("w", (F.col("row_id") % 3).cast("double"))
    twice = d.where("w > 0").unionByName(d.where("w = 2"))
    schema = binning.fit_schema(d, KINDS, p.bins)
    a = boost.train(d.where("w > 0"), KINDS, "y", p, w="w", schema=schema)
    b = boost.train(twice, KINDS, "y", p, schema=schema)
    assert [t.feature for t in a.trees] == [t.feature for t in b.trees]
    assert a.trees[1].value == pytest.approx(b.trees[1].value)


@pytest.mark.parametrize("objective", ["squared_error", "absolute_error", "quantile", "pseudo_huber"])
def test_regression_objectives(spark, learnable, objective):
    m = boost.train(learnable, KINDS, "s", boost.BoostParams(n_rounds=8, loss=losses.Loss(objective), tree=boost.TreeParams(max_depth=3, split=splits.SplitParams(learning_rate=0.4))))
    out = model.predict(learnable, m, ["row_id", "s"])
    assert value(metrics.r2(out, "prediction", "s")) > 0.55


def test_poisson_and_softmax(spark, learnable):
    d = learnable.withColumn("n", F.floor(F.greatest(F.lit(0.0), F.col("s") + 1)).cast("double")).withColumn("k", F.when(F.col("s") > 0.7, 2.0).when(F.col("s") > 0, 1.0).otherwise(0.0))
    p = boost.train(d, KINDS, "n", boost.BoostParams(n_rounds=6, loss=losses.Loss("poisson"), tree=boost.TreeParams(max_depth=3)))
    assert model.predict(d, p, ["row_id"]).where("prediction <= 0").count() == 0
    m = boost.train(d, KINDS, "k", boost.BoostParams(n_rounds=5, loss=losses.Loss("softmax", num_class=3), tree=boost.TreeParams(max_depth=3, split=splits.SplitParams(learning_rate=0.3))))
    assert len(m.trees) == 15
    out = model.predict(d, m, ["k"]).withColumn("a", F.array("prediction_0", "prediction_1", "prediction_2")).withColumn("c", F.col("k").cast("int"))
    assert out.where(F.abs(F.col("prediction_0") + F.col("prediction_1") + F.col("prediction_2") - 1) > 1e-9).count() == 0
    assert value(metrics.accuracy(out, "a", "c")) > 0.7


def test_early_stop_and_continue(spark, learnable):
    d = learnable.withColumn("v", F.col("row_id") % 5 == 0)
    p = boost.BoostParams(n_rounds=40, early_stopping_rounds=3, tree=boost.TreeParams(max_depth=3, split=splits.SplitParams(learning_rate=0.8)))
    m = boost.train(d, KINDS, "y", p, valid="v")
    assert len(m.trees) < 40 and len(m.trees) == m.history.index(max(m.history)) + 1  # by AUC
    one = boost.BoostParams(n_rounds=2, tree=boost.TreeParams(max_depth=3))
    first = boost.train(learnable, KINDS, "y", one)
    n = len(first.trees)
    more = boost.train(learnable, KINDS, "y", one, start=first)
    straight = boost.train(learnable, KINDS, "y", boost.BoostParams(n_rounds=4, tree=boost.TreeParams(max_depth=3)))
    assert n == 2 and [t.feature for t in more.trees] == [t.feature for t in straight.trees]


def test_forest(spark, learnable):
    m = boost.train_forest(learnable, KINDS, "y", boost.ForestParams(n_trees=10, max_depth=6, trees_per_job=5))
    out = model.predict(learnable, m, ["row_id", "y"])
    assert value(metrics.auc(out, "prediction", "y")) > 0.9
    assert out.where("prediction < 0 OR prediction > 1").count() == 0


def test_linear_leaves(spark, learnable):
    """On a sloped target they beat constant leaves of the same trees, and agree with a ridge fit of one leaf."""
    d = learnable.withColumn("t", 0.3 * F.coalesce("a", F.lit(8.0)) - 0.2 * F.coalesce("b", F.lit(8.0)))
    how = dict(n_rounds=3, loss=losses.Loss("squared_error"))
    plain, sloped = (boost.train(d, KINDS, "t", boost.BoostParams(tree=boost.TreeParams(max_depth=2, linear_leaves=x, lin_leaf_lambda=0.01), **how)) for x in (False, True))
    a, b = (value(metrics.rmse(model.predict(d, m, ["t"]), "prediction", "t")) for m in (plain, sloped))
    assert b < a
    assert model.Model.from_json(sloped.to_json()).trees[0].lin == sloped.trees[0].lin
    rows_ = d.select("a", "t").dropna().toPandas()
    one = boost.train(d.select("row_id", "a", "t").dropna(), {"a": "numeric"}, "t", boost.BoostParams(n_rounds=1, loss=losses.Loss("squared_error"), bins=binning.BinParams(min_data_in_bin=1), tree=boost.TreeParams(max_depth=1, linear_leaves=True, lin_leaf_lambda=0.5, split=splits.SplitParams(learning_rate=1.0))))
    t = one.trees[0]
    edges = one.schema.features[0].edges
    bins = np.searchsorted(edges, rows_["a"], side="left") + 1
    mid = np.concatenate([[0.0, edges[0]], (np.array(edges[:-1]) + np.array(edges[1:])) / 2, [edges[-1]]])
    for leaf, keep in ((t.left[0], bins <= t.threshold[0]), (t.right[0], bins > t.threshold[0])):
        x, g = mid[bins[keep]], one.base[0] - rows_["t"].to_numpy()[keep]
        z = (x - x.mean()) / x.std()
        want = -(g @ z) / (z @ z + 0.5 * len(z)) / x.std()
        assert t.lin[str(leaf)][1][0] == pytest.approx(want)


def test_targets_in_symmetric_trees(spark):
    d = spark.range(3000).withColumnRenamed("id", "row_id").withColumn("c", F.when(F.col("row_id") % 17 > 0, F.concat(F.lit("l"), (F.xxhash64("row_id") % 20).cast("string")))).withColumn("e", F.concat(F.lit("e"), (F.xxhash64(F.lit(3), "row_id") % 9).cast("string")))
    d = d.withColumn("y", F.when(F.coalesce(F.xxhash64("c") % 3 == 0, F.lit(False)) != (F.xxhash64("e") % 4 == 0), 1.0).otherwise(0.0)).cache()
    kinds = {"c": "categorical", "e": "categorical"}
    scores = []
    for pairs in (1, 2):
        m = boost.train(d, kinds, "y", boost.BoostParams(n_rounds=5, tree=boost.TreeParams("symmetric", 4, max_ctr_complexity=pairs)))
        assert {f.kind for f in m.schema.features} == {"target"}
        scores.append(value(metrics.auc(model.predict(d, model.Model.from_json(m.to_json()), ["y"]), "prediction", "y")))
    assert scores[0] > 0.8 and scores[1] >= scores[0] - 0.02
    before = targets.before_counts(d, ["c"], "y", "row_id", chunks=7).orderBy("row_id").collect()
    seen = {}
    for r in before:
        assert (r["__pos"], r["__n"]) == seen.get(r["c"], (0, 0))
        p, n = seen.get(r["c"], (0, 0))
        seen[r["c"]] = p + int(r["y"]), n + 1


def test_refusals(spark, learnable):
    for bad in (dict(grow_policy="x"), dict(max_depth=0), dict(subsample=0.0)):
        with pytest.raises(ValueError):
            boost.TreeParams(**bad)
    for bad in ("x", '{"format": "timberline", "version": 9}', "[]"):
        with pytest.raises(ValueError):
            model.Model.from_json(bad)


def brute_shap(t, bins, cover):
    """Shapley values by subsets: features outside the subset follow cover."""
    def expect(row, known, n=0):
        f = t.feature[n]
        if f < 0:
            return t.value[n]
        l, r = t.left[n], t.right[n]
        if f in known:
            return expect(row, known, l if (t.missing_left[n] if row[f] == 0 else row[f] <= t.threshold[n]) else r)
        return (cover[l] * expect(row, known, l) + cover[r] * expect(row, known, r)) / cover[n]

    k = bins.shape[1]
    out = np.zeros(bins.shape)
    for i, row in enumerate(bins):
        for f in range(k):
            rest = [x for x in range(k) if x != f]
            for size in range(k):
                for s in itertools.combinations(rest, size):
                    w = math.factorial(size) * math.factorial(k - size - 1) / math.factorial(k)
                    out[i, f] += w * (expect(row, {*s, f}) - expect(row, set(s)))
    return out


def test_shap(spark, learnable):
    m = boost.train(learnable, KINDS, "y", boost.BoostParams(n_rounds=2, tree=boost.TreeParams(max_depth=5)))
    bins = np.random.default_rng(1).integers(0, 17, (12, 4))
    for t in m.trees:
        phi, bias = explain.tree_shap_values(t, bins)
        assert phi == pytest.approx(brute_shap(t, bins, t.hess), abs=1e-9)
        assert phi.sum(axis=1) + bias == pytest.approx(t.predict(bins), abs=1e-9)
    out = explain.tree_shap(learnable.limit(50), m, ["row_id"])
    raw = model.predict(learnable, m, ["row_id"], raw=True)
    both = out.join(raw, "row_id").toPandas()
    assert both[[c for c in both if c.startswith("shap_")]].sum(axis=1).to_numpy() == pytest.approx(both["prediction"].to_numpy())


def test_stump_shap():
    s = model.stump("v", 4.0, -1.5, 2.5, 10.0, 30.0, 0.25)
    phi, bias = explain.tree_shap_values(s.trees[0], np.array([[1], [2]]))
    assert bias == 1.5 and phi[:, 0].tolist() == [-3.0, 1.0]


def test_linear(spark, learnable):
    cols = ["a", "b", "c"]
    d = learnable.na.fill(8.0)
    m = linear.fit(d, cols, "s", linear.LinearParams("squared_error", reg_lambda=50.0))
    x = d.toPandas()
    z = np.column_stack([(x[c] - x[c].mean()) / x[c].std(ddof=0) for c in cols])
    y = x["s"].to_numpy()
    want = np.linalg.solve(z.T @ z + 50 * np.eye(3), z.T @ (y - y.mean()))
    assert m.coefficients[0] == pytest.approx(want, abs=1e-6)
    w0, *w = linear.ridge(d, cols, "s", 0.0)
    assert np.column_stack([np.ones(len(y)), x[cols]]) @ np.array([w0, *w]) == pytest.approx(np.column_stack([np.ones(len(y)), x[cols]]) @ np.linalg.lstsq(np.column_stack([np.ones(len(y)), x[cols]]), y, rcond=None)[0])
    m = linear.fit(d, cols, "y", linear.LinearParams("logistic", reg_lambda=5.0))
    b, t = np.zeros(4), x["y"].to_numpy()
    zz = np.column_stack([np.ones(len(t)), z])
    for _ in range(30):  # Newton
        p = 1 / (1 + np.exp(-zz @ b))
        pen = np.diag([0, 5.0, 5.0, 5.0])
        b -= np.linalg.solve(zz.T @ (zz * (p * (1 - p))[:, None]) + pen, zz.T @ (p - t) + pen @ b)
    assert m.coefficients[0] == pytest.approx(b[1:], abs=1e-5)


def test_gradients_are_derivatives(spark):
    fs = {"logistic": lambda r, y: np.log1p(np.exp(r)) - y * r, "squared_error": lambda r, y: (r - y) ** 2 / 2, "pseudo_huber": lambda r, y: 4 * (np.sqrt(1 + (r - y) ** 2 / 4) - 1), "poisson": lambda r, y: np.exp(r) - y * r}
    pts = [(0.3, 1.0), (-1.2, 0.0), (2.0, 1.0)]
    d = spark.createDataFrame(pts, "r double, y double")
    for k, f in fs.items():
        g, _ = losses.gradients(losses.Loss(k, huber_slope=2.0), F.col("r"), F.col("y"))
        got = [x.g for x in d.select(g.alias("g")).collect()]
        assert got == pytest.approx([(f(r + 1e-5, y) - f(r - 1e-5, y)) / 2e-5 for r, y in pts], abs=1e-6)
        a, _ = boost._gradients(losses.Loss(k, huber_slope=2.0), np.array([[r] for r, _ in pts]), np.array([y for _, y in pts]), np.ones(3), 0)
        assert a == pytest.approx(got)


# Search


def test_axes():
    a = search.Axis.parse("lambda=1..100:log")
    assert a.grid(3)[1] == pytest.approx(10.0)
    assert search.Axis.parse("d=3..9:int").at(0.5) == 6
    assert search.Axis.parse("p=a,b").grid(5) == ["a", "b"]
    for bad in ("x", "x=", "x=5..1", "x=0..1:log", "x=1..2:odd"):
        with pytest.raises(ValueError):
            search.Axis.parse(bad)
    assert a.near_edge(1.01) and not a.near_edge(10)


@pytest.mark.parametrize("strategy", ["grid", "random", "bayes", "bandit"])
def test_strategies(strategy):
    axes = [search.Axis.parse("x=0..1"), search.Axis.parse("c=a,b")]

    def evaluate(p, k):
        if p["x"] > 0.95:
            raise ValueError("refused")
        return 1 - (p["x"] - 0.3) ** 2 - (0.1 if p["c"] == "b" else 0)

    got = search.search(axes, evaluate, strategy, trials=30, seed=2)
    assert got[0].score == max(t.score for t in got) and got[0].params["c"] == "a"
    assert abs(got[0].params["x"] - 0.3) < 0.15
    assert got == search.search(axes, evaluate, strategy, trials=30, seed=2)


def test_cross_validation(spark, learnable):
    d = rows.folds(learnable, ["row_id"], 3, 1, "y").cache()
    r = search.cross_validate(d, "y", lambda t: linear.fit(t, ["a", "b", "c"], "y"), linear.predict, "auc", k=3)
    assert r.oof.count() == d.count() and len(r.scores) == 3
    assert abs(r.pooled - r.mean) < 0.05


def test_stream(spark, learnable, tmp_path):
    from timberline.streaming.scoring import score_stream

    learnable.limit(100).write.parquet(str(tmp_path / "in"))
    m = boost.train(learnable, KINDS, "y", boost.BoostParams(n_rounds=2, tree=boost.TreeParams(max_depth=3)))
    s = spark.readStream.schema(learnable.schema).parquet(str(tmp_path / "in"))
    score_stream(s, m, str(tmp_path / "out"), str(tmp_path / "check"), ["row_id"]).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 100


def test_csv_is_split_where_it_can_be(spark, tmp_path):
    for name, text, multi in (("a", 'x,y\n1,"p"\n2,q\n', False), ("b", 'x,y\n1,"p\nr"\n2,q\n', True)):
        (tmp_path / f"{name}.csv").write_text(text)
        assert tables.spans_lines(spark, str(tmp_path / f"{name}.csv")) == multi
        frame = tables.read_csv(spark, str(tmp_path / f"{name}.csv"))
        assert [r.y for r in frame.df.orderBy("row_id").collect()] == ["p\nr" if multi else "p", "q"]
        frame.release()
        assert frame.df.count() == 2


def test_ids_as_written(spark, tmp_path):
    d = spark.createDataFrame([(7.0, 0.5), (1.5, 0.25), (None, 1.0), (float(1 << 25), 0.0)], "id double, prediction double")
    tables.write_predictions(d.coalesce(1), str(tmp_path / "p"), ["prediction"], "id")
    rows = [r.value for r in spark.read.text(str(tmp_path / "p")).collect()]
    assert rows[:4] == ["id,prediction", "7,0.500000", "1.5,0.250000", '"",1.000000'] and rows[4].endswith(",0.000000")


def test_unparsed_and_wide(spark):
    d = spark.createDataFrame([("1", "a"), ("x", "b"), ("na", "c"), (None, "c")], "n string, c string")
    assert [tuple(r) for r in profile.unparsed(d, ["n"]).collect()] == [("n", 1)]
    p = profile.profile(d, [], ["c"])
    assert profile.wide(p).count() == 0 and [tuple(r) for r in profile.wide(p, 3).collect()] == [("c", 3)]
