"""Draws of a bootstrap, each from a hash."""

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

#: Larger means are drawn one by one by numpy's own sampler.
SMALL = 64


def poisson_draws(marks: np.ndarray, means: np.ndarray) -> np.ndarray:
    """Poisson numbers with the given means, each by its 64-bit mark alone: the least whose chance of no more reaches the mark's share of one."""
    bits = marks.astype(np.int64).view(np.uint64)
    u = ((bits >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
    out = np.zeros(len(bits), dtype=np.int64)
    left = np.flatnonzero(means <= SMALL)
    chance = np.exp(-means[left])
    upto, k = chance.copy(), 0
    while len(left) and k < 10 * SMALL:
        more = u[left] > upto
        left, chance, upto, k = left[more], chance[more], upto[more], k + 1
        out[left] = k
        chance = chance * means[left] / k
        upto = upto + chance
    for at in np.flatnonzero(means > SMALL):
        out[at] = np.random.Generator(np.random.PCG64(int(bits[at]))).poisson(means[at])
    return out


@pandas_udf(LongType())
def poisson(mark: pd.Series, mean: pd.Series) -> pd.Series:
    return pd.Series(poisson_draws(mark.to_numpy(), mean.to_numpy(dtype=np.float64)))
