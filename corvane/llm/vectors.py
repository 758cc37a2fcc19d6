"""Which vectors can be compared, and how rows of arrays become matrices."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vec: str) -> Column:
    """Whether a vector is not null, not empty, not zero, and has only finite components."""
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce((F.size(vec) > 0) & F.forall(vec, ok) & F.exists(vec, lambda x: x != 0), F.lit(False))


def matrix(column: pd.Series) -> np.ndarray:
    """Rows of equal length as doubles."""
    return np.array(column.tolist(), np.float64).reshape(len(column), -1)
