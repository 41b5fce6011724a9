"""The commands as functions over DataFrames: train, predict, blend, info, profile, cv, tune, explain."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import DEFAULT, metric
from ..operators import profile as profiles
from ..operators import rows as rowops
from ..operators.binning import BinParams, POLICIES, fit_schema
from ..sources.tables import ROW, drop_columns
from . import boost, explain, linear, model, search
from .config import Config, configured


@dataclass
class Bundle:
    """A model with how its target was encoded."""

    model: model.Model | linear.LinearModel
    label: str
    objective: str
    classes: list[str]


def kinds_of(df: DataFrame, skip: set[str]) -> dict[str, str]:
    """Numbers are numeric, text is categorical; other types must be turned into one of them first."""
    out = {}
    for name, kind in df.dtypes:
        if name in skip:
            continue
        if kind in ("string", "boolean"):
            out[name] = "categorical"
        elif kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
            out[name] = "numeric"
        else:
            raise ValueError(f"column {name} has type {kind}; turn it into a number or text")
    if not out:
        raise ValueError("no features are left")
    return out


def encoded(df: DataFrame, label: str, objective: str, classes: list[str] | None = None, pos_label: str | None = None) -> tuple[DataFrame, list[str]]:
    """The label as a number. Text takes its class's place in order; pos_label swaps with the last class."""
    if dict(df.dtypes)[label] != "string":
        if pos_label is not None:
            raise ValueError("pos_label needs a text label")
        if objective != "softmax":
            return df.withColumn(label, F.col(label).cast("double")), []
        if classes is None:
            found = [r["class"] for r in rowops.encode_labels(df, label, numeric=True).orderBy("index").collect()]
            if any(v != int(v) or abs(v) > 1 << 24 for v in found):
                raise ValueError("numeric classes must be whole numbers")
            classes = [str(int(v)) for v in found]
        value = F.col(label).cast("double").cast("long").cast("string")
    else:
        if pos_label is not None and objective == "softmax":
            raise ValueError("pos_label has no meaning with many classes")
        if classes is None:
            classes = [r["class"] for r in rowops.encode_labels(df, label).orderBy("index").collect()]
            if pos_label is not None:
                if pos_label not in classes:
                    raise ValueError(f"no class {pos_label}")
                i = classes.index(pos_label)
                classes[i], classes[-1] = classes[-1], classes[i]
        value = F.col(label)
    if len(classes) < 2 or objective == "logistic" and len(classes) > 2:
        raise ValueError(f"{len(classes)} classes don't suit {objective}")
    place = F.array_position(F.array(*map(F.lit, classes)), value) - 1
    out = df.withColumn(label, F.when(place >= 0, place).cast("double"))
    if out.where(F.col(label).isNull()).limit(1).count():
        raise ValueError("labels are missing or of classes that training didn't see")
    return out, classes


def fit(df: DataFrame, label: str, config: Config, kinds: dict[str, str], weight: str | None = None, row: str = ROW, valid: str | None = None, classes: list[str] = (), start: model.Model | None = None, init: list[str] | None = None, schema=None):
    """The configured algorithm on rows whose label is a number already."""
    objective = config.linear.objective if config.algo == "linear" else config.boost.loss.objective
    if config.class_weight == "balanced":
        own = rowops.class_weights(df.where(~F.col(valid)) if valid else df, label, weight).select(F.col("class").alias("__c"), F.col("weight").alias("__cw"))
        df = df.join(F.broadcast(own), df[label] == own["__c"], "left").withColumn("__w", F.coalesce("__cw", F.lit(1.0)) * (F.lit(1.0) if weight is None else F.col(weight))).drop("__c", "__cw")
        weight = "__w"
    if config.algo == "linear":
        m = linear.fit_design(df.where(~F.col(valid)) if valid else df, kinds, label, config.linear, weight, config.boost.bins, schema)
        m.classes = list(classes) if objective == "softmax" else []
        return m
    if config.algo == "forest":
        return boost.train_forest(df.where(~F.col(valid)) if valid else df, kinds, label, config.forest, weight, row, objective == "logistic")
    params = config.boost
    if params.bins.bin_policy == "auto" and start is None:
        params = replace(params, bins=replace(params.bins, bin_policy=auto_policy(df, kinds, label, params, weight, row)))
    m = boost.train(df, kinds, label, params, weight, row, valid, schema, start, init)
    m.classes = list(classes) if objective == "softmax" else []
    return m


def auto_policy(df: DataFrame, kinds: dict[str, str], label: str, params: boost.BoostParams, weight: str | None = None, row: str = ROW) -> str:
    """Three folds of each binning policy; the first of the best."""
    d = rowops.folds(df, [row], 3, 1).persist()
    name = DEFAULT[params.loss.objective]
    sign = 1 if name in ("auc", "r2", "accuracy", "aucpr") else -1
    scores = []
    for policy in POLICIES[:-1]:
        own = replace(params, bins=replace(params.bins, bin_policy=policy))
        r = search.cross_validate(d, label, lambda t, own=own: boost.train(t, kinds, label, own, weight, row), lambda t, m: model.predict(t, m), name, k=3)
        scores.append((-sign * round(r.pooled, 12), len(scores), policy))
    d.unpersist()
    return min(scores)[2]


def train(df: DataFrame, label: str, config: Config | None = None, drop: list[str] = (), weight: str | None = None, valid_frac: float = 0.2, split_seed: int = 1, split_col: str | None = None, row: str = ROW, pos_label: str | None = None, extra: str | None = None, extra_weight: float = 1.0, init_model: Bundle | None = None, init: list[str] | None = None) -> tuple[Bundle, dict]:
    """Fits on the training side and scores the other. extra: a boolean column of rows that always train, times extra_weight."""
    config = config or Config()
    objective = config.linear.objective if config.algo == "linear" else config.boost.loss.objective
    df = drop_columns(df, list(drop))
    if weight:
        rowops.check_weights(df, weight)
    if extra_weight < 0:
        raise ValueError("extra_weight must not be negative")
    d, classes = encoded(df, label, objective, init_model.classes or None if init_model else None, pos_label)
    if split_col:
        d = d.withColumn("__valid", rowops.split_column(F.col(split_col).cast("double")))
    else:
        main = d.where(~F.col(extra)) if extra else d
        side = rowops.holdout(main, [row], valid_frac, split_seed).select(F.col(row).alias("__r"), F.col("is_valid"))
        d = d.join(side, d[row] == side["__r"], "left").withColumn("__valid", F.coalesce("is_valid", F.lit(False))).drop("__r", "is_valid")
    if extra:
        d = d.withColumn("__valid", F.col("__valid") & ~F.col(extra)).withColumn("__xw", F.when(F.col(extra), extra_weight).otherwise(1.0) * (F.lit(1.0) if weight is None else F.col(weight)))
    d = d.persist()
    skip = {label, row, "__valid", "__xw", *( [weight] if weight else []), *([split_col] if split_col else []), *([extra] if extra else []), *(init or [])}
    kinds = kinds_of(d, skip)
    fitted = fit(d, label, config, kinds, "__xw" if extra else weight, row, "__valid", classes, init_model.model if init_model else None, init)
    bundle = Bundle(fitted, label, objective, classes)
    held = d.where("__valid")
    report = {"rows": d.count(), "valid_rows": held.count()}
    if report["valid_rows"]:
        report["score"] = score(held, bundle, config.eval_metric or None)
    d.unpersist()
    return bundle, report


def predict(df: DataFrame, bundle: Bundle, keep: list[str] | None = None) -> DataFrame:
    if isinstance(bundle.model, linear.LinearModel):
        out = linear.predict(df, bundle.model)
        return out if keep is None else out.select(*keep, "prediction")
    return model.predict(df, bundle.model, keep)


def score(df: DataFrame, bundle: Bundle, name: str | None = None) -> float:
    """The objective's metric, or another, over rows whose label is a number. Unweighted."""
    name = name or DEFAULT[bundle.objective]
    out = predict(df, bundle)
    if bundle.objective == "softmax" and "prediction" not in out.columns:
        out = out.withColumn("prediction", F.array(*(F.col(f"prediction_{c}") for c in (bundle.model.classes or range(bundle.model.width)))))
    how = {"raw": False} if name == "mlogloss" else {}
    if bundle.objective == "softmax":
        out = out.withColumn(bundle.label, F.col(bundle.label).cast("int"))
    return metric(name, out, "prediction", bundle.label, **how).first()["value"]


def blend(df: DataFrame, bundles: list[Bundle], weights: list[float], row: str = ROW) -> DataFrame:
    """row, prediction: the weighted mean of models of the same features."""
    names = [sorted({c for f in b.model.schema.features for c in (f.source or [f.name])}) if isinstance(b.model, model.Model) else sorted(b.model.inputs) for b in bundles]
    if any(n != names[0] for n in names):
        raise ValueError("blended models must have the same features")
    out = df
    for i, b in enumerate(bundles):
        p = predict(df, b, [row]).select(F.col(row).alias("__r"), F.col("prediction").alias(f"__p{i}"))
        out = out.join(p, out[row] == p["__r"]).drop("__r")
    return out.select(row, model.blend([F.col(f"__p{i}") for i in range(len(bundles))], weights).alias("prediction"))


def info(bundle: Bundle) -> dict:
    m = bundle.model
    if isinstance(m, linear.LinearModel):
        return {"kind": "linear", "features": len(m.features), "outputs": len(m.intercepts), "objective": m.objective}
    return {"kind": "forest" if m.average else "trees", "trees": len(m.trees), "nodes": sum(len(t.feature) for t in m.trees), "features": len(m.schema.features), "bins": {f.name: f.n_bins for f in m.schema.features}, "base": m.base, "objective": m.objective, "classes": m.classes}


def profile(df: DataFrame, row: str = ROW) -> DataFrame:
    kinds = kinds_of(df, {row})
    return profiles.profile(df, [c for c, k in kinds.items() if k == "numeric"], [c for c, k in kinds.items() if k != "numeric"])


def cv(df: DataFrame, label: str, config: Config | None = None, folds: int = 5, fold_seed: int = 1, repeats: int = 1, group: str | None = None, weight: str | None = None, row: str = ROW, drop: list[str] = (), first: int | None = None, pos_label: str | None = None, extra: str | None = None, extra_weight: float = 1.0, init: list[str] | None = None, oof: str | None = None, schema=None) -> list[search.CvResult]:
    """A result for each repeat. Bins are made once, from features only. Folds use given weights; class weights only train.

    extra: a boolean column of rows that train in every fold, times extra_weight, and are in none; oof: where the first
    repeat's predictions are written; schema: bins made before, of the same columns and settings.
    """
    config = config or Config()
    objective = config.linear.objective if config.algo == "linear" else config.boost.loss.objective
    if extra_weight < 0:
        raise ValueError("extra_weight must not be negative")
    d, classes = encoded(drop_columns(df, list(drop)), label, objective, None, pos_label)
    if weight:
        rowops.check_weights(d, weight)
    side = [c for c in (weight, group, extra) if c] + list(init or [])
    kinds = kinds_of(d, {label, row, *side})
    own = "__xw" if extra else weight
    if extra:
        d = d.withColumn("__xw", F.when(F.col(extra), extra_weight).otherwise(1.0) * (F.lit(1.0) if weight is None else F.col(weight)))
    if schema is None and binned(config):
        schema = fit_schema(d, kinds, config.boost.bins)
    out = []
    for r in range(repeats):
        main = d.where(~F.col(extra)) if extra else d
        dealt = rowops.grouped_folds(main, group, folds, fold_seed + r) if group else rowops.folds(main, [row], folds, fold_seed + r, label if objective in ("logistic", "softmax") else None)
        if extra:
            dealt = dealt.unionByName(d.where(F.col(extra)).withColumn("fold", F.lit(None).cast("int")))
        dealt = dealt.persist()
        one = lambda t: Bundle(fit(_stopping(t, config, row, label), label, config, kinds, own, row, "__stop" if _stops(config) else None, classes, init=init, schema=schema), label, objective, classes)
        out.append(search.cross_validate(dealt, label, one, lambda t, b: _single(predict(t, b), b), config.eval_metric or DEFAULT[objective], k=folds, w=weight, first=first))
        if oof and not r:
            search.write_oof(out[0], oof, label)
    return out


def binned(config: Config) -> bool:
    """Whether bins can be made before rows are dealt."""
    return config.algo != "forest" and config.boost.bins.bin_policy != "auto"


def _stops(config: Config) -> bool:
    return config.algo == "gbdt" and config.boost.early_stopping_rounds > 0


def _stopping(df: DataFrame, config: Config, row: str, label: str) -> DataFrame:
    """With early stopping a tenth of each training side is set apart to stop on."""
    return rowops.stop_slice(df, [row], config.boost.tree.seed, label).withColumnRenamed("is_stop", "__stop") if _stops(config) else df


def _single(out: DataFrame, b: Bundle) -> DataFrame:
    if b.objective == "softmax" and "prediction" not in out.columns:
        return out.withColumn("prediction", F.array(*(F.col(f"prediction_{c}") for c in (b.model.classes or range(b.model.width)))))
    return out


#: What is searched when nothing is named.
SPACES = {
    "gbdt": ("learning_rate=0.02..0.3:log", "max_depth=3..10:int", "min_child_samples=5..100:int:log", "lambda=0.01..100:log", "subsample=0.5..1", "colsample_bytree=0.5..1"),
    "forest": ("max_leaves=64..2048:int:log", "min_child_samples=1..50:int:log", "colsample_bynode=0.2..1"),
    "linear": ("lambda=0.0001..10000:log", "alpha=0.0001..1000:log"),
}


def tune(df: DataFrame, label: str, fixed: dict | None = None, space: list[str] | None = None, strategy: str = "random", trials: int = 40, folds: int = 5, confirm: int = 0, confirm_seeds: int = 2, row: str = ROW, group: str | None = None, weight: str | None = None, init: list[str] | None = None, drop: list[str] = (), pos_label: str | None = None, out: str | None = None, **how) -> tuple[list[search.Trial], dict]:
    """Trials, best first, and a report: axes whose winner lies at an end, whether the winner's score repeats, scores on unseen seeds.

    Bins are made again only where a trial changes their settings. out: where the trials are written.
    """
    fixed = dict(fixed or {})
    algo = fixed.get("algo", "gbdt")
    skip = {label, row, *(c for c in (group, weight) if c), *(init or []), *drop}
    if space is None:
        space = [s for s in SPACES[algo] if s.split("=")[0] not in fixed]
        if any(k == "string" for c, k in df.dtypes if c not in skip) and algo == "gbdt" and "cat_split" not in fixed:
            space.append("cat_split=ordinal,optimal")
    axes = [search.Axis.parse(s) for s in space]
    made: dict = {}

    def bins_of(c: Config):
        if not binned(c):
            return None
        if c.boost.bins not in made:
            d = drop_columns(df, list(drop))
            made[c.boost.bins] = fit_schema(d, kinds_of(d, skip - set(drop)), c.boost.bins)
        return made[c.boost.bins]

    def evaluate(p: dict, k: int, seed: int = 1) -> float:
        c = configured(**fixed, **p)
        return cv(df, label, c, folds, seed, 1, group, weight, row, drop, min(k, folds), pos_label, init=init, schema=bins_of(c))[0].pooled

    found = search.search(axes, evaluate, strategy, trials, folds, configured(**fixed).eval_metric or DEFAULT[fixed.get("objective", "logistic")], **how)
    report: dict = {"edges": [a.name for a in axes if found and a.near_edge(found[0].params[a.name])]}
    if found:
        report["repeats"] = abs(evaluate(found[0].params, folds) - found[0].score) <= 1e-9
        report["confirmed"] = [[evaluate(t.params, folds, 1000 + s) for s in range(confirm_seeds)] for t in found[:confirm]]
    if out:
        search.write_trials(df.sparkSession, found, out)
    return found, report


def explained(df: DataFrame, bundle: Bundle, keep: list[str], cover: str = "hess", top: int | None = None, shap: str | None = None, check: bool = True) -> tuple[DataFrame, DataFrame]:
    """Importance of the features, the `top` largest, and Shapley values of the rows, of every class.

    check: refuses values that don't sum to the raw score; shap: where the values are written, with the first of keep as id.
    """
    m = bundle.model
    many = [f"shap_{c}_" for c in (m.classes or range(m.width if isinstance(m, model.Model) else len(m.intercepts)))] if bundle.objective == "softmax" else ["shap_"]
    if isinstance(m, linear.LinearModel):
        values, of = explain.linear_model_shap(df, m, keep), m.inputs
        sizes: dict[str, float] = {}
        for cs in m.coefficients:
            for (f, _), c in zip(m.design.columns if m.design else [(f, None) for f in m.features], cs):
                sizes[f] = sizes.get(f, 0.0) + abs(float(c))
        found = df.sparkSession.createDataFrame(sorted(sizes.items()), "feature string, gain double")
        raws = [r.alias(f"__raw{i}") for i, r in enumerate(linear.raw_scores(m))]
        both = explain.linear_model_shap(df.select("*", *raws), m, [*keep, *(f"__raw{i}" for i in range(len(raws)))]) if check else None
    else:
        values, found, of = explain.tree_shap(df, m, keep, cover), explain.importance(m.nodes(df.sparkSession)), [f.name for f in m.schema.features]
        both = explain.tree_shap(df, m, [], cover, raw=True) if check else None
    if both is not None:
        for i, head in enumerate(many):
            explain.check_additive(both, F.col(f"__raw{i}"), [*(f"{head}{f}" for f in of), f"{head}bias"])
    if shap:
        explain.write_shap(values, shap, keep[0] if keep else None)
    return explain.top(found, [c for c in found.columns if c != "feature"][0], top), values


__all__ = ["BinParams", "Bundle", "blend", "cv", "explained", "fit", "info", "predict", "profile", "score", "train", "tune"]
