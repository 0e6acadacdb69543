"""Model registry and fitting.

``fit`` builds one ``pyspark.ml`` pipeline: categorical inputs are indexed
and one-hot encoded (fitted on the training rows only), numeric inputs pass
through, the vector is standardised where the profile asks for it, and the
estimator follows. The class label is indexed outside the pipeline, so a
scoring table needs no target column. MLlib distributes every fit; the only
driver-side numbers are the few statistics that map the reference's
penalties onto MLlib's (n and the label's std).

Penalty mappings (the reference's objective -> MLlib's), with sigma_y the
population std of the label and n the number of training rows:
  ridge       alpha             -> regParam = alpha * sigma_y / n, elasticNet 0
  lasso       alpha             -> regParam = alpha, elasticNet 1
  elastic net alpha, l1_ratio r -> lam = alpha r + alpha (1-r) sigma_y,
                                   elasticNet = alpha r / lam
  logistic    C = 1             -> regParam = 1 / (C n)
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import ElementwiseProduct, IndexToString, StringIndexer
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.params import canonical_model, canonical_task
from quarry.operators.prep import encoder_stages, plain_name, plain_names, quoted

# The two parameter profiles of each model kind.
PROFILES = {
    ("regression", "linear"): {"core": {}, "gui": {}},
    ("regression", "ridge"): {"core": {"alpha": 1.0, "scale": False}, "gui": {"alpha": 1.0, "scale": True}},
    ("regression", "lasso"): {"core": {"alpha": 1.0, "scale": False, "max_iter": 1000},
                              "gui": {"alpha": 0.001, "scale": True, "max_iter": 10000}},
    ("regression", "elasticnet"): {"core": {"alpha": 1.0, "l1_ratio": 0.5, "scale": False, "max_iter": 1000},
                                   "gui": {"alpha": 0.001, "l1_ratio": 0.5, "scale": True, "max_iter": 10000}},
    ("regression", "rf"): {"core": {"trees": 100}, "gui": {"trees": 300}},
    ("regression", "hgb"): {"core": {"rounds": 100, "lr": 0.1, "depth": 5, "min_leaf": 20, "bins": 255, "l2": 0.0},
                            "gui": {"rounds": 100, "lr": 0.1, "depth": 5, "min_leaf": 20, "bins": 255, "l2": 0.0}},
    ("regression", "xgb"): {"core": {"rounds": 100, "lr": 0.3, "depth": 6, "subsample": 1.0, "colsample": 1.0, "l2": 1.0},
                            "gui": {"rounds": 500, "lr": 0.05, "depth": 6, "subsample": 0.9, "colsample": 0.9, "l2": 1.0}},
    ("regression", "svr"): {"core": {"C": 1.0, "epsilon": 0.1, "components": 500},
                            "gui": {"C": 10.0, "epsilon": 0.1, "components": 500}},
    ("regression", "knn"): {"core": {"k": 5}, "gui": {"k": 5}},
    ("classification", "linear"): {"core": {"C": 1.0, "max_iter": 2000}, "gui": {"C": 1.0, "max_iter": 2000}},
    ("classification", "ridge"): {"core": {"C": 1.0, "max_iter": 2000}, "gui": {"C": 1.0, "max_iter": 2000}},
    ("classification", "rf"): {"core": {"trees": 100}, "gui": {"trees": 300}},
    ("classification", "hgb"): {"core": {"rounds": 100, "lr": 0.1, "depth": 5, "min_leaf": 20, "bins": 255, "l2": 0.0},
                                "gui": {"rounds": 100, "lr": 0.1, "depth": 5, "min_leaf": 20, "bins": 255, "l2": 0.0}},
    ("classification", "xgb"): {"core": {"rounds": 100, "lr": 0.3, "depth": 6, "subsample": 1.0, "colsample": 1.0, "l2": 1.0},
                                "gui": {"rounds": 500, "lr": 0.05, "depth": 6, "subsample": 0.9,
                                        "colsample": 0.9, "l2": 1.0}},
    ("classification", "knn"): {"core": {"k": 5}, "gui": {"k": 5}},
}

SCALED_KINDS = {"svr", "knn"}
TREE_KINDS = {"rf", "hgb", "xgb"}
BOOSTED_KINDS = {"hgb", "xgb"}
MAX_TREE_DEPTH = 30   # MLlib's limit; the reference grows forests fully
FOREST_BINS = 255     # candidate thresholds per input of every tree model
# Least share of the training rows in a forest's leaf: up to 10,000 rows a leaf may
# hold one row, as in the reference; beyond, it bounds a tree at 20,000 nodes.
MIN_LEAF_SHARE = 1e-4


@dataclass
class FittedModel:
    """A fitted pipeline plus what scoring needs to know about it."""
    pipeline: PipelineModel
    task: str
    kind: str
    target: str
    inputs: list
    labels: list | None = None          # class values in index order
    label_type: str | None = None
    params: dict = field(default_factory=dict)
    input_types: dict = field(default_factory=dict)

    @property
    def pred_col(self) -> str:
        return f"{self.target}_pred" if self.target else "prediction"

    def transform(self, df: DataFrame, keep_index: bool = False) -> DataFrame:
        """G1 core: every input column plus ``<target>_pred`` (and, for a
        binary classifier, ``score`` = probability of the second class)."""
        names = df.columns
        df = plain_names(df)
        out = self._transform(df, keep_index)
        return out.toDF(*names, *out.columns[len(names):]) if df.columns != names else out

    def _transform(self, df: DataFrame, keep_index: bool) -> DataFrame:
        out = self._scored(df)
        extra = []
        if self.task == "classification":
            out = IndexToString(inputCol="prediction", outputCol="__pred_lab", labels=self.labels).transform(out)
            pred = F.col("__pred_lab")
            if self.label_type and self.label_type != "string":
                pred = pred.cast(self.label_type)
            if "probability" in out.columns and len(self.labels) == 2:
                from pyspark.ml.functions import vector_to_array
                extra.append(vector_to_array("probability")[1].alias("score"))
            if keep_index:
                extra.append(F.col("prediction").alias("__pred_index"))
        else:
            pred = F.col("prediction")
        return out.select(*df.columns, pred.alias(self.pred_col), *extra)

    def _scored(self, df: DataFrame) -> DataFrame:
        """``df`` through the pipeline."""
        if self.kind != "rf":
            return self.pipeline.transform(df)
        from quarry.operators.forest import scored
        return scored(PipelineModel(self.pipeline.stages[:-1]).transform(df), self.pipeline.stages[-1])

    def tree_models(self):
        """The fitted tree ensemble (or None)."""
        est = self.pipeline.stages[-1]
        return est if self.kind in TREE_KINDS else None

    def feature_names(self) -> list:
        """Names of the assembled vector slots (one-hot slots named
        ``col=value``)."""
        names = []
        enc = [s for s in self.pipeline.stages if type(s).__name__ == "StringIndexerModel"]
        cat_labels = {}
        if enc:
            m = enc[0]
            for c, labs in zip(m.getInputCols(), m.labelsArray):
                cat_labels[c] = labs
        for c in self.inputs:
            if plain_name(c) in cat_labels:
                names += [f"{c}={v}" for v in cat_labels[plain_name(c)]]
            else:
                names.append(c)
        return names


def fit_encoder(df: DataFrame, inputs) -> PipelineModel:
    """The feature stages alone (index, one-hot, assemble to ``features``)."""
    enc, _ = encoder_stages(df, inputs, scale=False, out="features")
    return Pipeline(stages=list(enc)).fit(df)


class KnnFitted(FittedModel):
    """FittedModel of the exact kNN models: the feature pipeline plus the
    standardised training rows; prediction joins back on the key."""

    def __init__(self, *args, knn=None, **kw):
        super().__init__(*args, **kw)
        self.knn = knn

    def _transform(self, df: DataFrame, keep_index: bool) -> DataFrame:
        key = plain_name(self.params["key"])
        pred = self.knn.predict(df, key)
        if self.task == "classification":
            lab = F.element_at(F.array(*[F.lit(v) for v in self.labels]), F.col("prediction").cast("int") + 1)
            if self.label_type and self.label_type != "string":
                lab = lab.cast(self.label_type)
            pred = pred.select(key, lab.alias(self.pred_col))
        else:
            pred = pred.withColumnRenamed("prediction", self.pred_col)
        return df.join(pred, key, "left").select(*df.columns, quoted(self.pred_col))


def _label_stats(df: DataFrame, label: str):
    r = df.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(label).alias("s")).first()
    return int(r["n"]), float(r["s"] or 0.0)


def _boosted(data: DataFrame, kind: str, p: dict, seed: int, classes: int):
    """Second-order boosted trees with the profile's parameters."""
    from quarry.operators.boost import fit_boosted
    loss = "squared" if not classes else "logistic" if classes == 2 else "softmax"
    return fit_boosted(data, loss, classes, int(p["rounds"]), p["lr"], int(p["depth"]), p["l2"], int(p.get("min_leaf", 1)),
                       1.0 if kind == "xgb" else 1e-3, int(p.get("bins", FOREST_BINS)), p.get("subsample", 1.0), p.get("colsample", 1.0), seed,
                       2.0 if kind == "xgb" else 1.0)


def _estimator(task: str, kind: str, p: dict, n: int, sigma_y: float, seed: int):
    from pyspark.ml import classification as C
    from pyspark.ml import regression as R
    common = dict(featuresCol="features", labelCol="label", predictionCol="prediction")
    depth = min(MAX_TREE_DEPTH, int(p.get("max_depth", MAX_TREE_DEPTH)))
    leaf = max(1, math.ceil(n * float(p.get("min_leaf_share", MIN_LEAF_SHARE))))
    if task == "regression":
        if kind == "linear":
            return R.LinearRegression(regParam=0.0, elasticNetParam=0.0, solver="normal", **common)
        if kind == "ridge":
            return R.LinearRegression(regParam=p["alpha"] * sigma_y / max(n, 1), elasticNetParam=0.0,
                                      standardization=False, solver="normal", **common)
        if kind == "lasso":
            return R.LinearRegression(regParam=p["alpha"], elasticNetParam=1.0, standardization=False,
                                      maxIter=p["max_iter"], tol=1e-10, **common)
        if kind == "elasticnet":
            a, r = p["alpha"], p["l1_ratio"]
            lam = a * r + a * (1 - r) * sigma_y
            return R.LinearRegression(regParam=lam, elasticNetParam=(a * r / lam) if lam else 0.0,
                                      standardization=False, maxIter=p["max_iter"], tol=1e-10, **common)
        if kind == "rf":
            return R.RandomForestRegressor(numTrees=p["trees"], featureSubsetStrategy="all", maxDepth=depth,
                                           minInstancesPerNode=leaf, bootstrap=bool(p.get("bootstrap", True)),
                                           maxBins=FOREST_BINS, seed=seed, **common)
    else:
        if kind in ("linear", "ridge"):
            return C.LogisticRegression(maxIter=p["max_iter"], regParam=1.0 / (p["C"] * max(n, 1)),
                                        elasticNetParam=0.0, standardization=False, tol=1e-10, **common)
        if kind == "rf":
            return C.RandomForestClassifier(numTrees=p["trees"], featureSubsetStrategy="sqrt", maxDepth=depth,
                                            minInstancesPerNode=leaf, bootstrap=bool(p.get("bootstrap", True)),
                                            maxBins=FOREST_BINS, seed=seed, **common)
    raise ValueError(f"no estimator for {task}/{kind}")


def spelled(model: FittedModel, target: str, inputs) -> FittedModel:
    """``model``, fitted on ``plain_names``, under the table's own names."""
    model.target, model.inputs = target, [c for c in inputs if c != target]
    model.input_types = {c: model.input_types[plain_name(c)] for c in model.inputs}
    return model


def fit(df: DataFrame, target: str, inputs, task: str = "regression", kind: str = "linear",
        profile: str = "core", seed: int = 42, encoder=None, **overrides) -> FittedModel:
    """Fit the pipeline for (task, kind, profile) on ``df`` (rows with a
    missing input or target are dropped first). Returns a FittedModel."""
    if any(plain_name(c) != c for c in df.columns):
        if "key" in overrides:
            overrides["key"] = plain_name(overrides["key"])
        m = fit(plain_names(df), plain_name(target), [plain_name(c) for c in inputs], task, kind, profile, seed, encoder, **overrides)
        return spelled(m, target, inputs)
    task = canonical_task(task)
    kind = canonical_model(task, kind)
    if profile not in ("core", "gui"):
        raise ValueError("profile must be 'core' or 'gui'")
    p = dict(PROFILES[(task, kind)][profile])
    p.update(overrides)
    inputs = [c for c in inputs if c != target]
    types = dict(df.dtypes)
    data = df.dropna(how="any", subset=list(inputs) + [target])
    labels, ltype = None, None
    if task == "classification":
        ltype = types[target]
        li = StringIndexer(inputCol=target, outputCol="label", stringOrderType="alphabetAsc").fit(data)
        labels = list(li.labels)
        if ltype != "string":   # order numeric classes numerically, not as text
            order = sorted(labels, key=lambda v: float(v))
            if order != labels:
                labels = order
                li = li.__class__.from_labels(labels, inputCol=target, outputCol="label")
        data = li.transform(data)
        n, sigma = data.count(), 0.0
        if len(labels) < 2:
            raise ValueError("classification needs at least two classes")
    else:
        data = data.withColumn("label", F.col(target).cast("double"))
        n, sigma = _label_stats(data, "label")
    if kind == "knn":
        key = p.get("key")
        if key is None:
            raise ValueError("knn needs key=<unique row key> (neighbour ties break by it)")
        from quarry.operators.knn import fit_knn
        km = fit_knn(data, inputs, task, int(p["k"]), key)
        return KnnFitted(km.features, task, kind, target, list(inputs), labels, ltype,
                         dict(p, profile=profile, seed=seed, d=km.d), {c: types[c] for c in inputs}, knn=km)
    scale = p.get("scale", kind in SCALED_KINDS)
    out_col = "__enc" if (scale or kind == "svr") else "features"
    if encoder is not None:
        # encoder fitted once on the whole training split (the reference one-hot
        # encodes before cross-validation); only its output column is renamed
        prefix = encoder
        if out_col != "features":
            from pyspark.ml.feature import SQLTransformer
            prefix = PipelineModel(stages=list(encoder.stages) + [SQLTransformer(
                statement=f"SELECT * EXCEPT (features), features AS {out_col} FROM __THIS__")])
    else:
        enc, _ = encoder_stages(data, inputs, scale=False, out=out_col)
        prefix = Pipeline(stages=list(enc)).fit(data)
    fitted = list(prefix.stages)
    cur = prefix.transform(data)
    if scale or kind == "svr":
        from pyspark.ml.feature import StandardScaler
        src = "__enc"
        sc = StandardScaler(inputCol=src, outputCol="__std", withMean=True, withStd=True).fit(cur)
        d = len(sc.mean)
        # population std, as the reference scales: multiply by sqrt(n/(n-1))
        k = math.sqrt(n / (n - 1)) if n > 1 else 1.0
        ep = ElementwiseProduct(scalingVec=Vectors.dense([k] * d), inputCol="__std",
                                outputCol="features" if kind != "svr" else "__scaled")
        fitted += [sc, ep]
        cur = ep.transform(sc.transform(cur))
        if kind == "svr":
            from quarry.operators.rff import rff_stage
            rs = rff_stage(d, p["components"], gamma=1.0 / d, seed=seed, inputCol="__scaled", outputCol="features")
            fitted.append(rs)
            cur = rs.transform(cur)
    if kind in BOOSTED_KINDS:
        model = _boosted(cur, kind, p, seed, len(labels or []))
    elif kind == "svr":
        from quarry.operators.svr import fit_svr
        model = fit_svr(cur, "__scaled", d, p["components"], 1.0 / d, seed, float(p["C"]), float(p["epsilon"]), sigma)
    elif kind == "rf":
        from quarry.operators.forest import fit_forest
        model = fit_forest(cur, _estimator(task, kind, p, n, sigma, seed), n, len(labels or []))
    else:
        model = _estimator(task, kind, p, n, sigma, seed).fit(cur)
    fitted.append(model)
    return FittedModel(PipelineModel(stages=fitted), task, kind, target, list(inputs), labels, ltype,
                       dict(p, profile=profile, seed=seed), {c: types[c] for c in inputs})
