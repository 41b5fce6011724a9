"""Settings: groups of parameters, flat overrides by name, and their validation, in the way that a command line gives them."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass, replace

from ..functions.losses import Loss
from ..operators.binning import BinParams
from ..operators.splits import SplitParams
from .boost import BoostParams, ForestParams, TreeParams
from .linear import LinearParams

ALGORITHMS = ("gbdt", "forest", "linear")

#: Other names of settings, and the settings they set.
ALIASES = {"lambda": "reg_lambda", "alpha": "reg_alpha", "lin_epochs": "max_iter", "lin_tol": "tol", "lin_standardize": "standardize", "score_function": "symmetric_score"}


@dataclass(frozen=True)
class Config:
    algo: str = "gbdt"
    class_weight: str = "none"
    eval_metric: str = ""
    boost: BoostParams = field(default_factory=BoostParams)
    forest: ForestParams = field(default_factory=ForestParams)
    linear: LinearParams = field(default_factory=LinearParams)

    def __post_init__(self):
        if self.algo not in ALGORITHMS:
            raise ValueError(f"unknown algo {self.algo}")
        if self.class_weight not in ("none", "balanced"):
            raise ValueError(f"unknown class_weight {self.class_weight}")
        if self.class_weight == "balanced" and self.boost.loss.objective not in ("logistic", "softmax"):
            raise ValueError("class weights need classes")


def _cast(text, like):
    if isinstance(like, bool):
        return text if isinstance(text, bool) else str(text).lower() in ("true", "1")
    if isinstance(like, int):
        return int(text)
    return float(text) if isinstance(like, float) or like is None else str(text)


def _apply(obj, name: str, value):
    """Sets the name in this group and in every group under it; returns the new object and how many were set."""
    changed, n = {}, 0
    for f in fields(obj):
        now = getattr(obj, f.name)
        if is_dataclass(now):
            new, k = _apply(now, name, value)
            if k:
                changed[f.name], n = new, n + k
        elif f.name == name:
            changed[f.name], n = _cast(value, now), n + 1
    return (replace(obj, **changed) if changed else obj), n


def configured(**flags) -> Config:
    """A flag sets its name in every group that has it; an unknown one is refused."""
    config, own = Config(), {}
    for name, value in flags.items():
        name = ALIASES.get(name, name)
        if name in ("algo", "class_weight", "eval_metric"):
            own[name] = str(value)
            if name == "eval_metric":
                config = replace(config, boost=replace(config.boost, eval_metric=str(value)))
            continue
        if name in ("objective",):
            config = replace(config, boost=replace(config.boost, loss=replace(config.boost.loss, objective=str(value))))
            if value in ("logistic", "squared_error", "softmax"):
                config = replace(config, linear=replace(config.linear, objective=str(value)))
            continue
        if name == "n_rounds":
            config = replace(config, forest=replace(config.forest, n_trees=int(value)))
        config, n = _apply(config, name, value)
        if not n and name != "n_rounds":
            raise ValueError(f"unknown setting {name}")
    return replace(config, **own)


__all__ = ["BinParams", "Config", "Loss", "SplitParams", "TreeParams", "configured"]
