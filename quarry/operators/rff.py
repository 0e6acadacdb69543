"""Random Fourier features (Rahimi and Recht 2007) for the approximate RBF
SVR (E8): z(x) = sqrt(2/D) cos(W x + b), W ~ N(0, 2 gamma), b ~ U(0, 2 pi).

W and b are drawn from the seed, so the stage stores only (d, D, gamma,
seed) and is saved with the pipeline. The map runs as an Arrow-batched
pandas UDF: one matrix product per batch.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rff_weights(d: int, components: int, gamma: float, seed: int):
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, np.sqrt(2.0 * gamma), size=(d, components))
    b = rng.uniform(0.0, 2.0 * np.pi, size=components)
    return w, b


class RandomFourierFeatures(Transformer, HasInputCol, HasOutputCol,
                            DefaultParamsReadable, DefaultParamsWritable):
    dim = Param(Params._dummy(), "dim", "input dimension", TypeConverters.toInt)
    components = Param(Params._dummy(), "components", "number of features", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "RBF gamma", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "random seed", TypeConverters.toInt)

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None, dim=1, components=200, gamma=1.0, seed=0):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df):
        d, D = self.getOrDefault(self.dim), self.getOrDefault(self.components)
        w, b = rff_weights(d, D, self.getOrDefault(self.gamma), self.getOrDefault(self.seed))
        scale = np.sqrt(2.0 / D)

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def z(col: pd.Series) -> pd.Series:
            x = np.stack(col.to_numpy()) if len(col) else np.zeros((0, d))
            return pd.Series(list(scale * np.cos(x @ w + b)))

        arr = vector_to_array(F.col(self.getInputCol()))
        return df.withColumn(self.getOutputCol(), array_to_vector(z(arr)))


def rff_stage(d: int, components: int, gamma: float, seed: int, inputCol: str, outputCol: str):
    return RandomFourierFeatures(inputCol=inputCol, outputCol=outputCol, dim=d,
                                 components=components, gamma=gamma, seed=seed)
