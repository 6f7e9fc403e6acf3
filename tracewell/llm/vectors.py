"""What the operators on embeddings share."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(column: str) -> Column:
    """True where a vector is neither null, empty nor zero and all its components are finite numbers."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(column, lambda x: x != 0), F.lit(False))


def common_dimension(vectors: DataFrame, column: str = "embedding") -> int:
    """The number of components that most vectors have; the smaller one of a tie; 0 for no vector."""
    row = vectors.groupBy(F.size(column).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return row["d"] if row else 0


def matrix(column: pd.Series, dimension: int) -> np.ndarray:
    if not len(column):
        return np.zeros((0, dimension))
    return np.stack(column.to_numpy()).astype(np.float64)
