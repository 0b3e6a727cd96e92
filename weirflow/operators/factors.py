"""Factor analysis of vectors from one pass of moments, and latent factors as columns.

The data are reduced to sums, products and a count; the fit works on the covariance alone, whose size is the number of
features squared. Projections and predictions are linear, so they are expressions over the vector column.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Least noise variance of a feature, as a share of its variance.
LEAST_NOISE = 1e-12


@dataclass(frozen=True)
class FactorModel:
    """x = mean + loadings' z + noise: loadings are (factors, features), noise the features' own variances."""

    mean: np.ndarray
    loadings: np.ndarray
    noise: np.ndarray
    log_likelihood: float
    rounds: int

    @property
    def importance(self) -> np.ndarray:
        """Squared length of each factor's loadings; the factors are sorted by it."""
        return (self.loadings**2).sum(axis=1)

    def covariance(self) -> np.ndarray:
        return self.loadings.T @ self.loadings + np.diag(self.noise)

    def weights(self, features: Sequence[int] | None = None) -> np.ndarray:
        """(factors, features): the mean of the factors given the centred features, all or some."""
        at = list(range(len(self.noise))) if features is None else list(features)
        f = self.loadings[:, at]
        fp = f / self.noise[at]
        return np.linalg.solve(np.eye(len(f)) + fp @ f.T, fp)

    def latent_covariance(self, features: Sequence[int] | None = None) -> np.ndarray:
        at = list(range(len(self.noise))) if features is None else list(features)
        f = self.loadings[:, at]
        return np.linalg.inv(np.eye(len(f)) + (f / self.noise[at]) @ f.T)

    def predicted_covariance(self, known: Sequence[int], wanted: Sequence[int]) -> np.ndarray:
        """Covariance of `wanted` features given `known` ones; the same for every row."""
        f = self.loadings[:, list(wanted)]
        return f.T @ self.latent_covariance(known) @ f + np.diag(self.noise[list(wanted)])


def vector_moments(df: DataFrame, v: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and covariance (over n) of an array column; see `grouped_moments`."""
    found = grouped_moments(df, v)
    if not found:
        raise ValueError("there is no finite vector")
    return found[()]


def grouped_moments(df: DataFrame, v: str, by: Sequence[str] = ()) -> dict[tuple, tuple[int, np.ndarray, np.ndarray]]:
    """Rows, mean and covariance (over n) of an array column, by group.

    Each task adds up its products and sends one number for each group and pair of features, so what is shuffled is
    bounded by tasks, groups and features. Rows with null or non-finite elements, or of another length than the longest,
    are left out. Products are taken about one of the rows, so large means lose no digits."""
    width = df.agg(F.max(F.size(v))).first()[0] or 0
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(*by, F.col(v).cast("array<double>").alias("v")).where((F.size("v") == width) & whole)
    first = rows.first() if width > 0 else None
    if first is None:
        return {}
    base = np.array(first["v"])
    kinds = "".join(f"`{c}` {k}, " for c, k in rows.dtypes if c != "v")
    i, j = np.triu_indices(width)

    def run(batches):
        held: dict[tuple, list] = {}
        for batch in batches:
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width) - base
            keys = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True)) if by else [()] * len(x)
            for key in dict.fromkeys(keys):
                part = x[[k == key for k in keys]] if by else x
                n, sums, products = held.get(key, (0, 0.0, 0.0))
                held[key] = n + len(part), sums + part.sum(axis=0), products + part.T @ part
        for key, (n, sums, products) in held.items():
            named = {c: pa.array([key[k]] * len(i), types[k]) for k, c in enumerate(by)}
            yield pa.RecordBatch.from_pydict(named | {"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "product": pa.array(products[i, j]), "sum": pa.array(sums[i]), "n": pa.array(np.full(len(i), n), pa.int64())})

    types = [f.type for f in rows.select(*by).limit(0).toArrow().schema] if by else []
    made = rows.mapInArrow(run, kinds + "i int, j int, product double, sum double, n long").groupBy(*by, "i", "j").agg(*(F.sum(c).alias(c) for c in ("product", "sum", "n"))).collect()
    out: dict[tuple, tuple] = {}
    for r in made:
        n, d, cov = out.setdefault(tuple(r[c] for c in by), (r["n"], np.zeros(width), np.zeros((width, width))))
        d[r["i"]] = r["sum"] / n
        cov[r["i"], r["j"]] = cov[r["j"], r["i"]] = r["product"] / n
    return {key: (n, base + d, cov - np.outer(d, d)) for key, (n, d, cov) in out.items()}


def fit(mean: np.ndarray, cov: np.ndarray, factors: int, rounds: int = 1000, tolerance: float = 1e-10) -> FactorModel:
    """Maximum likelihood by expectation and conditional maximisation.

    Given the noise, the best loadings are the leading axes of the covariance scaled by it; given those, the
    noise is what is left on the diagonal. Rounds end when the log-likelihood of a row gains less than `tolerance`. Each
    factor's largest loading is positive; factors come by importance."""
    p = len(cov)
    if not 0 < factors <= p:
        raise ValueError("factors must be from 1 to the number of features")
    var = np.diag(cov).copy()
    least = np.maximum(LEAST_NOISE * var, 1e-300)
    noise, before = np.maximum(var, least), -np.inf
    for k in range(1, rounds + 1):
        scale = np.sqrt(noise)
        values, axes = np.linalg.eigh(cov / np.outer(scale, scale))
        values, axes = values[::-1], axes[:, ::-1]
        top = np.maximum(values[:factors], 1 + 1e-15)
        loadings = (axes[:, :factors] * np.sqrt(top - 1) * scale[:, None]).T
        said = -0.5 * (p * np.log(2 * np.pi) + np.log(top).sum() + factors + values[factors:].sum() + np.log(noise).sum())
        if said - before < tolerance:
            break
        before, noise = said, np.maximum(var - (loadings**2).sum(axis=0), least)
    loadings = loadings * np.sign(loadings[np.arange(factors), np.abs(loadings).argmax(axis=1)])[:, None]
    loadings = np.where(np.isfinite(loadings), loadings, 0.0)
    return FactorModel(mean, loadings[np.argsort(-(loadings**2).sum(axis=1), kind="stable")], noise, float(said), k)


def factor_analysis(df: DataFrame, v: str, factors: int, **how) -> FactorModel:
    _, mean, cov = vector_moments(df, v)
    return fit(mean, cov, factors, **how)


def _linear(v: Column, at: Sequence[int], weights: np.ndarray, offset: np.ndarray) -> Column:
    """Array of the rows of `weights` times chosen elements of a vector, plus an offset."""
    rows = []
    for row, c in zip(weights.tolist(), offset.tolist(), strict=True):
        out = F.lit(c)
        for k, w in zip(at, row, strict=True):
            out = out + F.lit(w) * F.get(v, F.lit(int(k))).cast("double")
        rows.append(out)
    return F.array(*rows)


def project(model: FactorModel, v: str, features: Sequence[int] | None = None) -> Column:
    """The factors' means of a vector, from all features or some; null where one of them is null or absent."""
    at = list(range(len(model.noise))) if features is None else list(features)
    w = model.weights(at)
    return _linear(F.col(v), at, w, -w @ model.mean[at])


def predict(model: FactorModel, v: str, known: Sequence[int], wanted: Sequence[int]) -> Column:
    """Means of `wanted` features given `known` ones."""
    w = model.loadings[:, list(wanted)].T @ model.weights(known)
    return _linear(F.col(v), known, w, model.mean[list(wanted)] - w @ model.mean[list(known)])
