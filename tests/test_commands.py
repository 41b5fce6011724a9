"""The commands end to end on a small table."""

import pytest
from pyspark.sql import functions as F

from timberline.plans import commands
from timberline.plans.config import configured


@pytest.fixture(scope="module")
def data(spark):
    d = spark.range(1500).withColumnRenamed("id", "row_id")
    u = lambda k: F.pmod(F.xxhash64(F.col("row_id"), F.lit(k)), F.lit(1000)) / 1000.0
    d = d.withColumn("a", F.when(u(1) > 0.05, F.round(u(2), 2))).withColumn("b", F.round(u(3), 2)).withColumn("c", F.concat(F.lit("l"), F.floor(u(4) * 6).cast("string")))
    s = F.coalesce(F.col("a"), F.lit(0.3)) + 0.5 * (F.col("c") == "l2").cast("double") + 0.3 * u(5)
    return d.withColumn("y", F.when(s > 0.8, "yes").otherwise("no")).withColumn("k", F.when(s > 1, "x").when(s > 0.6, "y").otherwise("z")).withColumn("w", 1 + u(6)).withColumn("more", F.col("row_id") >= 1400).repartition(3).cache()


def test_train_predict_explain(spark, data):
    c = configured(n_rounds=6, max_depth=3, learning_rate=0.3, **{"lambda": 2.0})
    assert c.boost.tree.split.reg_lambda == 2.0 and c.linear.reg_lambda == 2.0
    b, report = commands.train(data, "y", c, drop=["k", "more"], weight="w")
    assert report["valid_rows"] == 300 and report["score"] > 0.85 and b.classes == ["no", "yes"]
    assert commands.info(b)["trees"] == 6
    imp, shap = commands.explained(data, b, ["row_id"])
    assert imp.count() >= 2 and shap.count() == 1500
    other, _ = commands.train(data, "y", configured(n_rounds=3, max_depth=2), drop=["k", "more"], weight="w")
    out = commands.blend(data, [b, other], [2, 1])
    assert out.where("prediction <= 0 OR prediction >= 1").count() == 0
    more, _ = commands.train(data, "y", c, drop=["k", "more"], weight="w", init_model=b)
    assert len(more.model.trees) == 12


def test_other_targets(spark, data):
    b, r = commands.train(data, "k", configured(objective="softmax", n_rounds=4, max_depth=3, learning_rate=0.4, class_weight="balanced"), drop=["y", "w", "more"])
    assert b.classes == ["x", "y", "z"] and r["score"] < 1.0
    b, r = commands.train(data, "y", configured(algo="forest", n_rounds=6, max_depth=5), drop=["k", "w"], extra="more", extra_weight=0.5)
    assert r["score"] > 0.8 and r["valid_rows"] == 280
    b, r = commands.train(data, "y", configured(algo="linear"), drop=["k", "w", "more"], pos_label="no")
    assert b.classes == ["yes", "no"] and r["score"] > 0.7
    with pytest.raises(ValueError, match="classes"):
        commands.train(data, "k", configured(), drop=["y"])
    with pytest.raises(ValueError, match="unknown setting"):
        configured(colour="red")


def test_cv_and_tune(spark, data):
    d = data.drop("k", "w", "more")
    r = commands.cv(d, "y", configured(algo="linear"), folds=3, repeats=2)
    assert len(r) == 2 and all(x.oof.count() == 1500 for x in r)
    g = commands.cv(d.withColumn("g", F.expr("row_id div 10")), "y", configured(algo="linear"), folds=3, group="g")
    assert 0.6 < g[0].pooled <= 1
    trials, report = commands.tune(d, "y", {"algo": "linear"}, ["lambda=0.1..10:log"], "random", 2, 2, confirm=1, confirm_seeds=1)
    assert len(trials) == 2 and report["repeats"] and len(report["confirmed"][0]) == 1


def test_profile(data):
    p = {r["column"]: r for r in commands.profile(data.drop("more")).collect()}
    assert p["c"]["distinct"] == 6 and p["a"]["missing"] > 0 and p["y"]["kind"] == "categorical"


def test_linear_uses_categories(spark, data):
    """Against the closed form over the design's columns, and with the category that the label depends on."""
    import numpy as np

    from timberline.plans import linear

    d = data.select("row_id", "a", "c", (F.when(F.col("c") == "l2", 3.0).otherwise(0.0) + F.coalesce("a", F.lit(0.5)) + F.col("w")).alias("t"))
    m = linear.fit_design(d, {"a": "numeric", "c": "categorical"}, "t", linear.LinearParams("squared_error", reg_lambda=4.0, tol=1e-12))
    assert m.features == ["a", *(f"c={x}" for x in m.design.schema.features[1].levels)] and len(m.features) == 7
    rows = m.design.applied(d).toPandas()
    x = rows[[f"__d{i}" for i in range(7)]].to_numpy()
    x = (x - x.mean(0)) / x.std(0)
    k = np.eye(8) * 4.0
    k[0, 0] = 0
    x1 = np.column_stack([np.ones(len(x)), x])
    want = np.linalg.solve(x1.T @ x1 + k, x1.T @ rows.t.to_numpy())
    assert np.allclose([m.intercepts[0], *m.coefficients[0]], want, atol=1e-4)
    b, r = commands.train(data, "y", configured(algo="linear"), drop=["k", "w", "more"])
    assert "c=l2" in b.model.features and b.model.inputs == ["a", "b", "c"]
    imp, shap = commands.explained(data, b, ["row_id"], top=2)
    assert imp.count() == 2 and set(shap.columns) == {"row_id", "shap_a", "shap_b", "shap_c", "shap_bias"}


def test_explain_many_classes_and_files(spark, data, tmp_path):
    d = data.drop("y", "w", "more")
    for algo in ("linear", "gbdt"):
        b, _ = commands.train(d, "k", configured(algo=algo, objective="softmax", n_rounds=2, max_depth=2))
        _, shap = commands.explained(d, b, ["row_id"], shap=str(tmp_path / algo))
        assert {f"shap_{k}_{f}" for k in "xyz" for f in ("a", "b", "c", "bias")} <= set(shap.columns)
        text = spark.read.csv(str(tmp_path / algo), header=True)
        assert text.columns[0] == "row_id" and text.count() == 1500 and len(text.first()["shap_x_a"].split(".")[1]) == 8


def test_wrong_values_are_refused(spark):
    from timberline.plans import explain

    d = spark.createDataFrame([(1.0, 2.0, 3.0), (1.0, 2.0, 3.1)], "shap_a double, shap_bias double, raw double")
    with pytest.raises(ValueError, match="miss the raw score"):
        explain.check_additive(d, F.col("raw"), ["shap_a", "shap_bias"])
    explain.check_additive(d.limit(1), F.col("raw"), ["shap_a", "shap_bias"])


def test_cv_side_columns_and_files(spark, data, tmp_path, monkeypatch):
    d = data.drop("k").withColumn("s", F.lit(0.1))
    c = configured(n_rounds=2, max_depth=2)
    r = commands.cv(d, "y", c, folds=2, repeats=2, weight="w", extra="more", extra_weight=0.5, init=["s"], pos_label="no", oof=str(tmp_path / "oof"))
    held = d.where(~F.col("more")).count()
    assert [x.oof.count() for x in r] == [held] * 2
    written = spark.read.csv(str(tmp_path / "oof"), header=True)
    assert written.columns == ["fold", "label", "prediction"] and written.count() == held
    made, real = [], commands.fit_schema
    monkeypatch.setattr(commands, "fit_schema", lambda *a: made.append(1) or real(*a))
    trials, _ = commands.tune(d.drop("more", "s"), "y", {"n_rounds": 1, "max_depth": 1}, ["learning_rate=0.1..0.3", "max_bin=8,16"], "grid", 4, 2, weight="w", out=str(tmp_path / "trials"))
    assert len(made) == 2 and len(trials) == 4
    rows = spark.read.csv(str(tmp_path / "trials"), header=True).collect()
    assert [int(x.rank) for x in rows] == [1, 2, 3, 4] and all(int(x.ms) > 0 for x in rows)


def test_refusals(spark):
    from timberline.operators import rows

    d = spark.range(30).selectExpr("cast(id as string) AS c", "1 AS one")
    with pytest.raises(ValueError, match="more than 9 classes"):
        rows.encode_labels(d, "c", most=9)
    with pytest.raises(ValueError, match="one class"):
        rows.encode_labels(d, "one")
