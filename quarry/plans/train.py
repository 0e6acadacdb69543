"""Train job (F9, F10): split -> fit -> cross-validate -> evaluate -> save.

Every step is a Spark job: splits are K1 positions, fits are MLlib fits,
metrics are aggregates over the transformed splits. Each CV fold is fitted
once and all metrics come from its predictions (the reference refits per
metric).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.params import canonical_model, canonical_task, resolve_seed
from quarry.operators import evaluate as ev
from quarry.operators import gram
from quarry.operators import split as sp
from quarry.operators.models import PROFILES, FittedModel, fit, spelled
from quarry.operators.prep import plain_name, plain_names


@dataclass
class TrainResult:
    fitted: FittedModel
    parity: DataFrame
    metrics: DataFrame
    cv: DataFrame | None
    seed: int
    n_train: int
    n_test: int
    parts: DataFrame | None = None      # the cached split, which parity and metrics read

    def release(self) -> None:
        """Free the cached split; parity and metrics are recomputed if read again."""
        if self.parts is not None:
            self.parts.unpersist()


def _pred_frame(fitted: FittedModel, df: DataFrame, split: str | None = None) -> DataFrame:
    out = fitted.transform(df)
    cols = [F.col(fitted.target).alias("actual"), F.col(fitted.pred_col).alias("predicted")]
    if "score" in out.columns:
        cols.append(F.col("score"))
    if split is not None:
        cols.append(F.lit(split).alias("split"))
    elif "split" in out.columns:
        cols.append(F.col("split"))
    return out.select(*cols)


def _model_params(task: str, kind: str, key: str, params: dict) -> dict:
    """``params`` for ``fit``; a neighbour model also needs the row key."""
    return {**params, "key": key} if canonical_model(task, kind) == "knn" else params


def metrics_table(fitted: FittedModel, pred: DataFrame, by="split") -> DataFrame:
    """F1 for regression; F2 (+ F3 when binary with a score) for classes."""
    if fitted.task == "regression":
        return ev.regression_metrics(pred, by=by)
    m = ev.classification_metrics(pred, by=by)
    if "score" in pred.columns and fitted.labels and len(fitted.labels) == 2:
        pos = fitted.labels[1]
        lab = pred.withColumn("__pos", (F.col("actual").cast("string") == F.lit(str(pos))).cast("int"))
        auc = ev.roc_auc(lab, "__pos", "score", 1, by=by)
        m = m.join(auc, [by] if isinstance(by, str) else by, "left")
    return m


def linear_moments(folds: DataFrame, enc, target: str, inputs):
    """The encoded rows of linear models and their moments per fold."""
    rows = enc.transform(folds.dropna(how="any", subset=[*inputs, target])).withColumn("label", F.col(target).cast("double"))
    rows = rows.select(F.col("fold").cast("int").alias("fold"), "features", "label")
    return rows, gram.fold_moments(rows)


def _linear_folds(folds: DataFrame, enc, target: str, inputs, kind: str, profile: str, params: dict) -> DataFrame:
    p = {**PROFILES[("regression", kind)][profile], **params}
    rows, moments = linear_moments(folds, enc, target, inputs)
    fits = gram.cross_fits(moments, float(p.get("alpha", 0.0)), bool(p.get("scale", False)))
    mae = gram.absolute_errors(rows, fits)
    table = [(gram.r2(m, fits[f]), mae[f]) for f, m in moments.items()]
    return ev.cv_summary(folds.sparkSession.createDataFrame(table, "r2 double, mae double"), ["r2", "mae"])


def cross_validate(train: DataFrame, target: str, inputs, task: str, kind: str, profile: str,
                   seed: int, key: str, k: int | None = None, parallelism: int = 4, **params) -> DataFrame:
    """k folds (stratified for classes, k = clamp(smallest class, 2, 5));
    one fit per fold; mean and population std of r2/mae or accuracy/f1. Linear and
    ridge regression take two scans for all folds (``operators.gram``)."""
    task = canonical_task(task)
    params = _model_params(task, kind, key, params)
    label = target if task == "classification" else None
    if k is None:
        k = sp.stratified_fold_count(train, target) if label else 5
    folds = sp.kfold(train, k, seed, key, label=label).persist()
    from quarry.operators.models import fit_encoder
    enc = fit_encoder(train.dropna(how="any", subset=[*inputs, target]), inputs)
    if task == "regression" and canonical_model(task, kind) in ("linear", "ridge"):
        out = _linear_folds(folds, enc, target, inputs, canonical_model(task, kind), profile, params)
        folds.unpersist()
        return out.withColumn("folds", F.lit(k))
    from quarry.session import run_parallel

    def one(f):
        m = fit(folds.where(F.col("fold") != f), target, inputs, task, kind, profile, seed, encoder=enc,
                **params)
        pred = _pred_frame(m, folds.where(F.col("fold") == f)).withColumn("fold", F.lit(f))
        t = metrics_table(m, pred, by="fold")
        return t.schema, t.collect()

    parts = run_parallel([lambda f=f: one(f) for f in range(k)], parallelism)
    allf = train.sparkSession.createDataFrame([r for _, rows in parts for r in rows], parts[0][0])
    cols = ["r2", "mae"] if task == "regression" else ["accuracy", "f1"]
    out = ev.cv_summary(allf, cols)
    folds.unpersist()
    return out.withColumn("folds", F.lit(k))


def train_model(df: DataFrame, target: str, inputs, task: str = "regression", kind: str = "linear",
                key: str = "id", test_size: float = 0.2, split_method: str | None = None,
                profile: str = "core", seed="42", cv: bool = True, out_dir: str | None = None,
                data_path: str | None = None, tune_mode: str = "off", trials: int | None = None,
                **params) -> TrainResult:
    """drop incomplete rows, split (stratified for classes unless told
    otherwise), fit, cross-validate on train, evaluate both splits, and
    optionally save the run (model, manifest, metrics, parity). With a
    ``tune_mode`` the parameters are first drawn and cross-validated on the
    train split (I1) and the best ones are refitted."""
    task = canonical_task(task)
    seed = resolve_seed(seed)
    inputs = [c for c in inputs if c != target]
    own = target, inputs
    df, key, target, inputs = plain_names(df), plain_name(key), plain_name(target), [plain_name(c) for c in inputs]
    data = df.select(*dict.fromkeys([key, *inputs, target])).dropna(how="any", subset=[*inputs, target])
    method = split_method or ("stratified" if task == "classification" else "random")
    parts = sp.split_train_test(data, method, test_size, seed, key=key,
                                stratify_col=target if method == "stratified" else None).persist()
    train, test = parts.where("split = 'train'").drop("split"), parts.where("split = 'test'").drop("split")
    if tune_mode != "off":
        from quarry.operators.tune import tune
        best, _ = tune(train, target, inputs, task, kind, key, tune_mode, trials, seed, profile, refit=False)
        params = {**params, **best}
    fitted = fit(train, target, inputs, task, kind, profile, seed, **_model_params(task, kind, key, params))
    cvt = cross_validate(train, target, inputs, task, kind, profile, seed, key, **params) if cv else None
    pred = _pred_frame(fitted, parts)
    par = pred.select("actual", "predicted", "split")
    metrics = metrics_table(fitted, pred)
    counts = {r["split"]: r["n"] for r in ev.split_counts(parts).collect()}
    spelled(fitted, *own)
    if out_dir:
        from quarry.sources import runs, sinks
        runs.save_model(fitted, out_dir)
        sinks.write_metrics(metrics, out_dir)
        sinks.write_parity(par, out_dir)
        if cvt is not None:
            cvt.coalesce(1).write.mode("overwrite").json(f"{out_dir}/cv")
        # last: a run with a whole manifest is a whole run
        runs.save_manifest(df.sparkSession, out_dir, fitted, seed, data_path,
                           {"method": method, "test_size": test_size, "key": key})
    return TrainResult(fitted, par, metrics, cvt, seed, counts.get("train", 0), counts.get("test", 0), parts)
