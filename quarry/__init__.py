"""quarry: find out what drives a target column, and model it, on Spark.

Every operator is a function from DataFrame to DataFrame. Estimators are
``pyspark.ml`` pipelines. Nothing passes a whole table through the driver:
the driver only ever sees schemas, parameters and small bounded tables
(cut points, per-bucket totals, metric rows).
"""

from quarry.session import get_spark, checkpoint_dir  # noqa: F401

__version__ = "0.1.0"
