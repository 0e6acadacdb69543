"""Explain job (H4): a saved run (or a fitted model) and a table give an
importance table and a report.

Inputs are resolved by name (B9). The method follows from the model: a tree
ensemble is explained by SHAP (H1), any other model by permutation importance
(H2), which needs the target; ``method`` asks for one of them. ``max_samples``
keeps the reference's exact-size sample (B15, md5 order); None explains every
complete row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.operators.explain import permutation_importance, top_importance
from quarry.operators.models import TREE_KINDS
from quarry.operators.prep import drop_incomplete, resolve_headers, sample_rows


def explain(spark: SparkSession, fitted, data: DataFrame, key: str, max_samples: int | None = None,
            seed: int = 42, repeats: int = 10, method: str = "auto", top: int | None = None):
    """(importance, report); the report counts the rows that were explained."""
    by_shap = {"auto": fitted.kind in TREE_KINDS, "shap": True, "permutation": False}[method]
    has_target = fitted.target in data.columns
    if not by_shap and not has_target:
        raise ValueError(f"the table lacks {fitted.target!r}, against which permuted predictions are scored")
    wanted = [*fitted.inputs, *([fitted.target] if has_target else [])]
    x = resolve_headers(data, list(dict.fromkeys([*wanted, key])))
    x = drop_incomplete(x, fitted.inputs if by_shap else wanted)
    if max_samples:
        x = sample_rows(x, int(max_samples), seed, key)
    if by_shap:
        from quarry.operators.shap import shap_importance
        imp = shap_importance(fitted, x)
    else:
        imp = permutation_importance(fitted, x, key, repeats, seed)
    report = spark.createDataFrame([("shap" if by_shap else "permutation", x.count())], "method string, n_samples long")
    return top_importance(imp, top) if top else imp.orderBy("importance", ascending=False), report


def explain_run(spark: SparkSession, run_dir: str, key: str, data: DataFrame | None = None, out: str | None = None, **options):
    """H4 from a run folder: its model, and its own training table unless another
    is given; with ``out`` the importance table and the report are written."""
    from quarry.sources import runs
    fitted = runs.load_model(spark, run_dir)
    imp, report = explain(spark, fitted, runs.run_data(spark, run_dir) if data is None else data, key, **options)
    if out:
        imp.coalesce(1).write.mode("overwrite").json(f"{out}/importance")
        report.coalesce(1).write.mode("overwrite").json(f"{out}/report")
    return imp, report
