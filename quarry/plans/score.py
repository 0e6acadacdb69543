"""Batch scoring (G1-G3): a saved pipeline applied to a new table.

``PipelineModel.transform`` is a narrow, per-row map (the fitted model is
shipped to every task once), so scoring needs no shuffle and scales with
the number of partitions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.prep import coerce_numeric, drop_incomplete, resolve_headers


def batch_predict(fitted, df: DataFrame) -> DataFrame:
    """G1: every input column plus the prediction; no cleaning."""
    return fitted.transform(df)


@dataclass
class ScoreResult:
    predictions: DataFrame
    rows_read: int
    rows_used: int

    def report(self) -> DataFrame:
        spark = self.predictions.sparkSession
        return spark.createDataFrame([(self.rows_read, self.rows_used, self.rows_read - self.rows_used)],
                                     "rows_read long, rows_used long, rows_dropped long")


def score_clean(fitted, df: DataFrame) -> ScoreResult:
    """Resolve the manifest's inputs by name (B9), coerce numeric inputs
    (B3), drop incomplete rows (B4), predict; output the inputs and the
    prediction. Raises when no row survives."""
    # a neighbour model finds its rows by their key
    key = [fitted.params["key"]] if fitted.kind == "knn" else []
    sel = resolve_headers(df, list(dict.fromkeys([*fitted.inputs, *key])))
    numeric = [c for c in fitted.inputs
               if fitted.input_types.get(c, "double") not in ("string", "boolean")]
    sel = coerce_numeric(sel, numeric)
    counts = sel.agg(F.count(F.lit(1)).alias("n"),
                     F.count_if(F.lit(True) if not fitted.inputs else
                                _all_present(fitted.inputs)).alias("u")).first()
    if counts["u"] == 0:
        raise ValueError("no row has every input present; nothing to score")
    clean = drop_incomplete(sel, fitted.inputs)
    out = fitted.transform(clean).select(*dict.fromkeys([*key, *fitted.inputs]), fitted.pred_col)
    return ScoreResult(out, int(counts["n"]), int(counts["u"]))


def score_run(spark, run_dir: str, df: DataFrame | None = None, out: str | None = None) -> ScoreResult:
    """G2 from a run folder: its model on ``df`` (or on the table it was trained
    on); with ``out`` the predictions and the report are written there."""
    from quarry.sources import runs, sinks
    r = score_clean(runs.load_model(spark, run_dir), runs.run_data(spark, run_dir) if df is None else df)
    if out:
        sinks.write_predictions(r.predictions, f"{out}/predictions")
        r.report().coalesce(1).write.mode("overwrite").json(f"{out}/report")
    return r


def _all_present(cols):
    e = F.lit(True)
    for c in cols:
        e = e & F.col(c).isNotNull()
    return e
