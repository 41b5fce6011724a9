"""Order statistics and sums over blocks of rows, and what training does with them, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.functions import losses
from timberline.operators import order, splits
from timberline.plans import blocks, boost

KINDS = {"a": "numeric", "c": "categorical"}


def packed(spark, y, w, row=None, size=64):
    row = range(len(y)) if row is None else row
    d = spark.createDataFrame([(int(r), float(a), float(b), 0.0, 1) for r, a, b in zip(row, y, w)], "row long, y double, w double, raw double, b int").repartition(3)
    return blocks.packed(d, 1, size)


def plain_percentile(v, w, alpha):
    """The rule, by hand: w None for unweighted."""
    if w is None:
        return float(np.percentile(v, 100 * alpha))
    o = np.argsort(v, kind="stable")
    v, cdf = np.asarray(v, float)[o], np.cumsum(np.asarray(w, float)[o])
    i = int((cdf > cdf[-1] * alpha).argmax()) if (cdf > cdf[-1] * alpha).any() else len(v) - 1
    if i in (0, len(v) - 1):
        return v[i]
    step = cdf[i] - cdf[i - 1]
    return (cdf[-1] * alpha - cdf[i - 1]) / step * (v[i] - v[i - 1]) + v[i - 1] if step >= 1 else v[i - 1]


def test_ordered_bits():
    x = np.array([-np.inf, -3.5, -1e-300, -0.0, 0.0, 1e-300, 2.0, 1e300, np.inf])
    bits = blocks.ordered_bits(x)
    assert (np.diff(bits.astype(object)) >= 0).all() and bits[3] == bits[4]
    assert (blocks.values_of(bits) == x).all()


@pytest.mark.parametrize("few", [1, 4096])
def test_kth(spark, few):
    rng = np.random.default_rng(4)
    y = rng.integers(-3, 4, 300).astype(float)
    row = rng.permutation(300)
    d = packed(spark, y, np.ones(300), row).persist()
    want = sorted(zip(y, row))
    for k in (1, 150, 300):
        key, r = blocks.kth(d, 3, lambda b: blocks.ordered_bits(b.y), k, few)
        assert (float(blocks.values_of(np.array([key], np.uint64))[0]), r) == (want[k - 1][0], want[k - 1][1])


@pytest.mark.parametrize("weighted", [False, True])
@pytest.mark.parametrize("few", [2, 65_536])
def test_group_percentiles(spark, weighted, few):
    rng = np.random.default_rng(5)
    n = 240
    y = np.where(rng.random(n) < 0.3, rng.integers(-2, 3, n), np.round(rng.normal(0, 100, n), 2))
    w = np.where(rng.random(n) < 0.1, 0.0, rng.choice([0.25, 1.0, 2.0, 30.0], n)) if weighted else np.ones(n)
    d = packed(spark, y, w).persist()
    group = lambda row: np.where(row % 5 == 4, -1, row % 4)
    for alpha in (0.5, 0.9):
        got = blocks.group_percentiles(d, 3, 5, lambda b: (group(b.row), b.y), alpha, weighted, few)
        for g in range(4):
            use = (group(np.arange(n)) == g) & (w > 0)
            assert got[g] == pytest.approx(plain_percentile(y[use], w[use] if weighted else None, alpha)), (g, alpha)
        assert np.isnan(got[4])


def test_weighted_percentile_brute_force(spark):
    rng = np.random.default_rng(6)
    for n in (1, 2, 5, 40):
        v, w = rng.integers(0, 8, n).astype(float), rng.choice([0.5, 1.0, 3.0], n)
        d = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(v, w))], "i long, v double, w double")
        for alpha in (0.5, 0.75):
            for few in (1, 100):
                got = order.weighted_percentile(d, "v", "w", alpha, "i", few).first()["value"]
                assert got == pytest.approx(plain_percentile(v, w, alpha)), (n, alpha)


def test_weighted_leaves_go_to_the_heavy_value(spark):
    d = spark.createDataFrame([(i, 1.0, "k", v, w) for i, (v, w) in enumerate(zip([1.0, 2.0, 3.0, 10.0], [1.0, 1.0, 1.0, 97.0]))], "row_id long, a double, c string, y double, w double")
    m = boost.train(d, {"a": "numeric"}, "y", boost.BoostParams(2, losses.Loss("absolute_error")), w="w")
    assert m.base == [10.0] and all(abs(t.value[0]) < 1e-12 for t in m.trees)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    a, c, z = rng.integers(0, 12, 900), rng.integers(0, 4, 900), rng.normal(0, 1, 900)
    y = (a + 3 * (c == 2) + z > 6).astype(float)
    d = spark.createDataFrame([(i, float(p), f"k{q}", float(t), float(0.5 + (i % 3)), i % 3) for i, (p, q, t) in enumerate(zip(a, c, y))], "row_id long, a double, c string, y double, w double, k int")
    return d.repartition(3).persist()


def nodes(m):
    return [(t.feature, t.threshold, t.missing_left, t.cats, np.round(t.value, 9).tolist()) for t in m.trees]


def test_counting_ahead_changes_no_tree(spark, rows, monkeypatch):
    p = boost.BoostParams(2, tree=boost.TreeParams("lossguide", 0, 9, splits.SplitParams(min_child_samples=3)))
    found, jobs, real = [], [], boost._histograms
    for ahead in (1, 8):
        n = []
        monkeypatch.setattr(boost, "_histograms", lambda *a, n=n: n.append(1) or real(*a))
        monkeypatch.setattr(boost.grow, "__defaults__", (ahead,))
        found.append(nodes(boost.train(rows, KINDS, "y", p)))
        jobs.append(len(n))
    assert found[0] == found[1] and jobs[1] < jobs[0]


def test_samples_are_exact(spark, rows):
    """A tree's root counts round(n * rate) rows; GOSS its top rows and its sample."""
    m = boost.train(rows, KINDS, "y", boost.BoostParams(2, tree=boost.TreeParams(max_depth=2, subsample=0.37)))
    assert [t.count[0] for t in m.trees] == [333.0, 333.0]
    for rank in ("gradient", "gradient_hessian"):
        p = boost.BoostParams(2, losses.Loss("softmax", num_class=3), boost.TreeParams(max_depth=2), sampling="goss", goss_warmup=False, goss_rank=rank)
        m = boost.train(rows, KINDS, "k", p)
        assert [t.count[0] for t in m.trees] == [270.0] * 6  # 180 of the largest, 90 of the others, for each class


def test_many_bins(spark):
    d = spark.createDataFrame([(i, float(i), float(i > 39_000)) for i in range(40_000)], "row_id long, a double, y double")
    m = boost.train(d, {"a": "numeric"}, "y", boost.BoostParams(1, tree=boost.TreeParams(max_depth=1), bins=boost.BinParams("quantile", 1, 65_535)))
    assert m.schema.features[0].n_bins == 40_001 and m.trees[0].threshold[0] == 39_001


def test_early_stopping_by_metric(spark, rows):
    d = rows.withColumn("v", F.col("row_id") % 4 == 0)
    for name in ("logloss", "error_rate", "auc"):
        m = boost.train(d, KINDS, "y", boost.BoostParams(12, tree=boost.TreeParams(max_depth=3, split=splits.SplitParams(learning_rate=0.9)), early_stopping_rounds=2, eval_metric=name), valid="v")
        best = max(m.history) if name == "auc" else min(m.history)
        assert len(m.trees) == m.history.index(best) + 1


def test_starting_scores_are_checked(spark, rows):
    for bad in (F.lit("x"), F.lit(None).cast("double"), F.lit(float("nan")), F.lit(float("inf"))):
        with pytest.raises(ValueError, match="starting scores"):
            boost.train(rows.withColumn("s", bad), KINDS, "y", boost.BoostParams(1), init=["s"])
    with pytest.raises(ValueError, match="2 columns"):
        boost.train(rows.withColumn("s", F.lit(0.0)), KINDS, "y", boost.BoostParams(1), init=["s", "s"])


def symmetric(**how):
    return boost.BoostParams(2, tree=boost.TreeParams("symmetric", 3, **how))


def test_symmetric_modes(spark, rows):
    plain = boost.train(rows, KINDS, "y", symmetric())
    for t in plain.trees:  # one test a level, counts of the leaves from all rows
        level = [0]
        while t.feature[level[0]] >= 0:
            assert len({(t.feature[n], t.threshold[n]) for n in level}) == 1
            level = [c for n in level for c in (t.left[n], t.right[n])]
        assert sum(t.count[n] for n in level) == 900
    more = boost.train(rows, KINDS, "y", symmetric(leaf_estimation_iterations=4))
    assert nodes(more)[0][:4] == nodes(plain)[0][:4] and nodes(more)[0][4] != nodes(plain)[0][4]
    for kind in ("bernoulli", "bayesian", "mvs"):
        m = boost.train(rows, KINDS, "y", symmetric(bootstrap_type=kind, subsample=0.6))
        t = m.trees[0]
        assert sum(t.count[n] for n, f in enumerate(t.feature) if f < 0) == 900  # sampling doesn't reach the leaves
    assert nodes(boost.train(rows, KINDS, "y", symmetric(random_strength=50.0))) != nodes(plain)
    doubled = boost.train(rows.withColumn("w", F.lit(2.0)), KINDS, "y", symmetric(), w="w")
    assert [n[:4] for n in nodes(doubled)] == [n[:4] for n in nodes(plain)]
    assert np.allclose(nodes(doubled)[0][4], nodes(plain)[0][4])  # lambda goes with the mean weight


def test_leaf_steps_reach_the_optimum(spark, rows):
    """Many Newton steps without a penalty: the mean of the gradient in each leaf is 0."""
    p = boost.BoostParams(1, tree=boost.TreeParams("symmetric", 1, split=splits.SplitParams(reg_lambda=0.0, learning_rate=1.0), leaf_estimation_iterations=25))
    m = boost.train(rows, {"a": "numeric"}, "y", p)
    t = m.trees[0]
    edge = m.schema.features[0].edges[t.threshold[0] - 1]
    for leaf, side in ((t.left[0], F.col("a") <= edge), (t.right[0], F.col("a") > edge)):
        mean = rows.where(side).agg(F.avg("y")).first()[0]
        assert 1 / (1 + np.exp(-(m.base[0] + t.value[leaf]))) == pytest.approx(mean, abs=1e-6)


def plain_ordered(bins, y, n_bins, rounds, depth, lam=1.0, lr=0.1):
    """Ordered boosting of logistic loss, by hand: the tests of each round, and the raw scores."""
    from timberline.operators.targets import ordered_prefixes

    n = len(y)
    base = np.log(y.mean() / (1 - y.mean()))
    pre = ordered_prefixes(n)
    approx, raw, tests = [np.full(t, base) for _, t in pre], np.full(n, base), []
    grad = lambda r, t: (1 / (1 + np.exp(-r)) - t, np.maximum(1 / (1 + np.exp(-r)) * (1 - 1 / (1 + np.exp(-r))), 1e-6))
    for _ in range(rounds):
        leaf, chosen = np.zeros(n, int), []
        for _ in range(depth):
            best = None
            for f in range(bins.shape[1]):
                for thr in range(n_bins[f] - 1):
                    num, den, side = 0.0, 1e-100, bins[:, f] > thr
                    if not any(side[leaf == x].any() and (~side[leaf == x]).any() for x in np.unique(leaf)):
                        continue
                    for (body, tail), a in zip(pre, approx):
                        g = grad(a, y[:tail])[0]
                        key = leaf[:tail] * 2 + side[:tail]
                        for x in np.unique(key):
                            own = key == x
                            b, t = own & (np.arange(tail) < body), own & (np.arange(tail) >= body)
                            est = g[b].sum() / (b.sum() + lam) if b.any() else 0.0
                            num, den = num + est * g[t].sum(), den + est * est * t.sum()
                    score = round(num / np.sqrt(den), 9)
                    if best is None or score > best[0]:
                        best = score, f, thr
            chosen.append(best[1:])
            leaf = leaf * 2 + (bins[:, best[1]] > best[2])
        tests.append(chosen)
        for (body, tail), a in zip(pre, approx):
            g, h = grad(a, y[:tail])
            for x in np.unique(leaf):
                own = (leaf[:tail] == x) & (np.arange(tail) < body)
                a[leaf[:tail] == x] -= lr * g[own].sum() / (h[own].sum() + lam)
        g, h = grad(raw, y)
        for x in np.unique(leaf):
            raw[leaf == x] -= lr * g[leaf == x].sum() / (h[leaf == x].sum() + lam)
    return tests, raw


def test_ordered_boosting_brute_force(spark):
    from timberline.plans import model

    rng = np.random.default_rng(8)
    n = 700
    a, c = rng.integers(0, 6, n), rng.integers(0, 4, n)
    y = (a + 2 * (c == 1) + rng.normal(0, 1.5, n) > 3.2).astype(float)
    d = spark.createDataFrame([(10 * i + 3, float(p), float(q), float(t)) for i, (p, q, t) in enumerate(zip(a, c, y))], "row_id long, a double, c double, y double").repartition(3)
    p = boost.BoostParams(10, tree=boost.TreeParams("symmetric", 2, boosting_type="ordered"))  # the blocks are written anew once
    m = boost.train(d, {"a": "numeric", "c": "numeric"}, "y", p)
    tests, raw = plain_ordered(np.column_stack([a + 1, c + 1]), y, [f.n_bins for f in m.schema.features], 10, 2)
    for t, want in zip(m.trees, tests):
        nodes_, got = [0], []
        while t.feature[nodes_[0]] >= 0:
            got.append((t.feature[nodes_[0]], t.threshold[nodes_[0]]))
            nodes_ = [x for node in nodes_ for x in (t.left[node], t.right[node])]
        assert got == want
    out = model.predict(d, m, ["row_id"], raw=True).toPandas().sort_values("row_id")
    assert np.allclose(out.prediction, raw, atol=1e-6)
    with pytest.raises(ValueError, match="symmetric"):
        boost.TreeParams("depthwise", boosting_type="ordered")
