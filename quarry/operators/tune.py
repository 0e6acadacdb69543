"""Tuning (I1). The reference declares budgets but never computes; here a
budget is the number of parameter sets that are tried, each scored by k-fold
cross-validation (one fit per fold). ``quick`` and ``intense`` draw them all at
random from a search space, seeded, so a larger budget always tries more.
``optuna`` and ``bayes`` spend the same number in batches of ``BATCH``: the first
``STARTUP`` sets are those of the random draws, and every later batch is drawn where
good sets have been dense and others rare (tree-structured Parzen estimator,
Bergstra et al. 2011). Numeric ranges are drawn on a log or linear scale. The sets of
a batch are independent distributed jobs and run a few at a time; the loop is bounded
by the budget, and what it knows of the past is one score per set.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame

from quarry.functions.params import canonical_model, canonical_task, tune_budget

# The search space of each model kind. ("log" or "lin", low, high)
# is a real range, ("int", low, high) a whole-number one.
SPACES = {
    "ridge": {"alpha": ("log", 0.01, 100.0)},
    "lasso": {"alpha": ("log", 0.0001, 1.0)},
    "elasticnet": {"alpha": ("log", 0.001, 1.0), "l1_ratio": ("lin", 0.1, 0.9)},
    "rf": {"trees": ("int", 50, 300), "max_depth": ("int", 8, 30)},
    "hgb": {"rounds": ("int", 50, 200), "lr": ("log", 0.05, 0.2), "depth": ("int", 3, 7)},
    "xgb": {"rounds": ("int", 100, 500), "lr": ("log", 0.05, 0.3), "depth": ("int", 4, 8)},
    "svr": {"C": ("log", 0.1, 100.0)},
    "linear": {"C": ("log", 0.01, 10.0)},
    "knn": {"k": ("int", 1, 50)},
}


DENSITY_PRESETS = ("optuna", "bayes")
STARTUP = 20            # random sets before the densities speak
BATCH = 5               # sets proposed from the same history
GOOD_SHARE = 0.1        # best sets that make the upper density
TRIES = 24              # values drawn from it per parameter, of which one is taken


def draws(kind: str, budget: int, seed: int) -> list[dict]:
    """``budget`` parameter sets, the same for the same seed."""
    space = SPACES.get(kind, {})
    if not space or budget <= 0:
        return [{}]
    rng = random.Random(seed)

    def one(scale, low, high):
        if scale == "int":
            return rng.randint(low, high)
        if scale == "log":
            return round(math.exp(rng.uniform(math.log(low), math.log(high))), 6)
        return round(rng.uniform(low, high), 6)

    return [{name: one(*space[name]) for name in sorted(space)} for _ in range(budget)]


class Density:
    """Values on the unit interval as a mixture of normals cut off at its ends, each
    as wide as the gap to its farther neighbour, and one wide one that reaches everywhere."""

    def __init__(self, values: list[float]):
        at = sorted(values)
        least = 1.0 / min(100, len(at) + 1)
        ends = [0.0, *at, 1.0]
        self.parts = [(v, max(v - ends[i], ends[i + 2] - v, least)) for i, v in enumerate(at)] + [(0.5, 1.0)]

    @staticmethod
    def _below(x: float, mean: float, width: float) -> float:
        return 0.5 * (1 + math.erf((x - mean) / (width * math.sqrt(2))))

    def __call__(self, x: float) -> float:
        return sum(math.exp(-((x - m) / w) ** 2 / 2) / w / (self._below(1, m, w) - self._below(0, m, w)) for m, w in self.parts)

    def draw(self, rng: random.Random) -> float:
        mean, width = rng.choice(self.parts)
        while True:
            x = rng.gauss(mean, width)
            if 0 <= x <= 1:
                return x


def proposals(kind: str, tried: list[tuple[dict, float]], count: int, seed: int) -> list[dict]:
    """``count`` parameter sets after those in ``tried`` (set, score; higher is better,
    a score that is no number is the worst); the same for the same seed and history."""
    space = SPACES[kind]
    ranked = sorted(tried, key=lambda t: -math.inf if math.isnan(t[1]) else t[1], reverse=True)
    cut = max(1, math.ceil(GOOD_SHARE * len(ranked)))

    def unit(scale, low, high, v):
        return math.log(v / low) / math.log(high / low) if scale == "log" else (v - low) / (high - low)

    def value(scale, low, high, u):
        if scale == "int":
            return min(high, low + int(u * (high - low + 1)))
        return round(low * (high / low) ** u if scale == "log" else low + u * (high - low), 6)

    spread = {name: [unit(*space[name], p[name]) for p, _ in ranked] for name in sorted(space)}
    good = {name: Density(v[:cut]) for name, v in spread.items()}
    rest = {name: Density(v[cut:]) for name, v in spread.items()}
    out = []
    for i in range(count):
        rng = random.Random(f"{seed}:{len(tried)}:{i}")
        best = {name: max((good[name].draw(rng) for _ in range(TRIES)), key=lambda x, n=name: good[n](x) / rest[n](x)) for name in good}
        out.append({name: value(*space[name], u) for name, u in best.items()})
    return out


def _ridge_scores(df: DataFrame, target: str, inputs, key: str, profile: str, seed: int, k: int):
    """Scores parameter sets by mean r2 from one scan: the folds' moments serve all penalties."""
    from quarry.operators import gram, split
    from quarry.operators.models import PROFILES, fit_encoder
    from quarry.plans.train import linear_moments
    folds = split.kfold(df, k, seed, key)
    _, moments = linear_moments(folds, fit_encoder(df.dropna(how="any", subset=[*inputs, target]), inputs), target, inputs)

    def score(p):
        p = {**PROFILES[("regression", "ridge")][profile], **p}
        fits = gram.cross_fits(moments, float(p["alpha"]), bool(p["scale"]))
        return sum(gram.r2(m, fits[f]) for f, m in moments.items()) / len(moments)

    return lambda cand: [score(p) for p in cand]


def tune(df: DataFrame, target: str, inputs, task: str, kind: str, key: str, mode: str = "quick",
         trials: int | None = None, seed: int = 42, profile: str = "core", k: int | None = None,
         parallelism: int = 4, refit: bool = True):
    """(best params, table of every draw with its CV score); the best draw is
    that with the highest score, the earlier of equals. With ``refit`` the first
    value is the model fitted on all rows with the best params."""
    from quarry.operators.models import fit
    from quarry.plans.train import _model_params, cross_validate
    from quarry.session import run_parallel
    task = canonical_task(task)
    kind = canonical_model(task, kind)
    mode = (mode or "off").strip().lower()
    budget = tune_budget(mode, trials)
    cand = [{}] if task == "regression" and kind == "linear" else draws(kind, budget, seed)
    col = "r2_mean" if task == "regression" else "f1_mean"
    kept = df.select(*dict.fromkeys([key, *inputs, target])).persist()

    def one(p):
        return float(cross_validate(kept, target, inputs, task, kind, profile, seed, key, k=k, parallelism=2, **p).first()[col])

    if task == "regression" and kind == "ridge":
        scored = _ridge_scores(kept, target, inputs, key, profile, seed, k or 5)
    else:
        def scored(sets):
            return run_parallel([lambda p=p: one(p) for p in sets], parallelism)
    if mode in DENSITY_PRESETS and len(cand) > STARTUP:
        cand = cand[:STARTUP]
        scores = scored(cand)
        while len(cand) < budget:
            batch = proposals(kind, list(zip(cand, scores, strict=True)), min(BATCH, budget - len(cand)), seed)
            cand, scores = cand + batch, scores + scored(batch)
    else:
        scores = scored(cand)
    rows = [(i, str(sorted(p.items())), s) for i, (p, s) in enumerate(zip(cand, scores, strict=True))]
    table = df.sparkSession.createDataFrame(rows, f"draw int, params string, {col} double")
    best = cand[max(range(len(cand)), key=lambda i: (scores[i], -i))]
    model = fit(kept, target, inputs, task, kind, profile, seed, **_model_params(task, kind, key, best)) if refit else best
    kept.unpersist()
    return model, table
