"""Harmonic regression by key."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoarfrost.functions import stats


def harmonic_fit(obs: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """Coefficients of two harmonics by key from sums of products (summed before the shuffle, 20 numbers a key), and the residuals' deviation."""
    basis = stats.harmonics(F.dayofyear(day))
    cols = obs.select(key, F.col(value).alias("y"), *[b.alias(f"b{i}") for i, b in enumerate(basis)]).where("y is not null")
    names = [(i, j) for i in range(5) for j in range(i, 5)]
    sums = [F.sum(F.col(f"b{i}") * F.col(f"b{j}")).alias(f"a{i}{j}") for i, j in names] + [F.sum(F.col(f"b{i}") * F.col("y")).alias(f"r{i}") for i in range(5)]
    grouped = cols.groupBy(key).agg(*sums, F.sum(F.col("y") * F.col("y")).alias("yy"), F.count(F.lit(1)).alias("n"))

    def solve(batches):
        for pdf in batches:
            a = np.zeros((len(pdf), 5, 5))
            for i, j in names:
                a[:, i, j] = a[:, j, i] = pdf[f"a{i}{j}"]
            rhs = pdf[[f"r{i}" for i in range(5)]].to_numpy(float)
            beta = (np.linalg.pinv(a, hermitian=True) @ rhs[:, :, None])[:, :, 0]
            fitted = np.einsum("ki,kij,kj->k", beta, a, beta)
            rest = np.maximum(0, pdf["yy"].to_numpy(float) - 2 * (beta * rhs).sum(axis=1) + fitted)
            n = pdf["n"].to_numpy()
            sigma = np.sqrt(rest / np.maximum(1, n - np.minimum(5, np.maximum(1, n - 1))))
            yield pd.DataFrame({key: pdf[key], "n": n, "beta": beta.tolist(), "sigma": sigma})

    return grouped.mapInPandas(solve, f"{key} {dict(grouped.dtypes)[key]}, n bigint, beta array<double>, sigma double")
