"""Linear and generalised linear models from sufficient statistics.

Data are reduced to Gram matrices by one aggregate; only those, whose size is the number of features
squared, reach the driver, where small systems are solved in numpy.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


def gram(df: DataFrame, x: Sequence[str], y: str, by: Sequence[str] = ()) -> dict[tuple, tuple[np.ndarray, np.ndarray, float, int]]:
    """X'X, X'y, y'y and the number of rows, by group. Rows with a null among them are left out."""
    x = list(x)
    rows = df.dropna(subset=[*x, y])
    cells = [F.sum(F.col(a) * F.col(b)).alias(f"g{i}_{j}") for i, a in enumerate(x) for j, b in enumerate(x) if i <= j]
    made = rows.groupBy(*by).agg(*cells, *(F.sum(F.col(a) * F.col(y)).alias(f"c{i}") for i, a in enumerate(x)), F.sum(F.col(y) * F.col(y)).alias("yy"), F.count("*").alias("n"))
    out = {}
    for r in made.collect():
        if not r["n"]:
            continue
        g = np.array([[r[f"g{min(i, j)}_{max(i, j)}"] for j in range(len(x))] for i in range(len(x))])
        out[tuple(r[b] for b in by)] = g, np.array([r[f"c{i}"] for i in range(len(x))]), r["yy"], r["n"]
    return out


def ridge(g: np.ndarray, c: np.ndarray, reg: float = 1e-10) -> np.ndarray:
    return np.linalg.solve(g + reg * np.eye(len(g)), c)


def mse(w: np.ndarray, g: np.ndarray, c: np.ndarray, yy: float, n: int) -> float:
    """Mean squared error of weights from moments."""
    return float(yy - 2 * w @ c + w @ g @ w) / n


def predict(w: np.ndarray, x: Sequence[str]) -> Column:
    out = F.lit(0.0)
    for name, v in zip(x, w.tolist(), strict=True):
        out = out + F.lit(v) * F.col(name)
    return out


def crossvalidated_ridge(df: DataFrame, x: Sequence[str], y: str, fold: str, reg: float = 1e-10) -> dict:
    """Weights and test error of each fold, trained on the others. One aggregate by fold is all that is
    read: training moments are the total less the fold's."""
    parts = gram(df, x, y, [fold])
    total = [sum(p[k] for p in parts.values()) for k in range(4)]
    out = {}
    for (f,), part in parts.items():
        w = ridge(total[0] - part[0], total[1] - part[1], reg)
        out[f] = {"weights": w, "mse": mse(w, *part)}
    return out


def ridge_sweep(df: DataFrame, x: Sequence[str], y: str, fold: str, strengths: Sequence[float]) -> dict[float, float]:
    """Mean test error over folds for each ridge strength, from one read."""
    parts = gram(df, x, y, [fold])
    total = [sum(p[k] for p in parts.values()) for k in range(4)]
    return {r: float(np.mean([mse(ridge(total[0] - p[0], total[1] - p[1], r), *p) for p in parts.values()])) for r in strengths}


def pca(df: DataFrame, x: Sequence[str], keep: int, centre: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors (rows) of X'X, uncentred as given, largest first."""
    ones = df.withColumn("_one", F.lit(1.0))
    ((g, c, _, n),) = gram(ones, x, "_one").values()
    if centre:
        g = g / n - np.outer(c, c) / n**2
    values, vectors = np.linalg.eigh(g)
    order = np.argsort(-values)[:keep]
    return values[order], vectors[:, order].T


def circular_regression(df: DataFrame, theta: str, y: str, by: Sequence[str] = ()) -> dict[tuple, dict[str, float]]:
    """y on cos, sin and 1: phase, depth and share of variance explained, by group."""
    rows = df.withColumns({"_c": F.cos(theta), "_s": F.sin(theta), "_1": F.lit(1.0)})
    out = {}
    for key, (g, c, yy, n) in gram(rows, ["_c", "_s", "_1"], y, by).items():
        w = ridge(g, c, 1e-9)
        var = yy / n - (c[2] / n) ** 2
        out[key] = {"phase": float(np.arctan2(w[1], w[0])), "depth": float(np.hypot(w[0], w[1])), "mean": float(w[2]), "r2": 1 - mse(w, g, c, yy, n) / var if var > 0 else float("nan")}
    return out


def poisson_glm(df: DataFrame, x: Sequence[str], y: str, reg: float = 0.0, rounds: int = 30, tolerance: float = 1e-9) -> np.ndarray:
    """Weights (constant first) of y ~ Poisson(exp(w x)) by Newton steps.

    Each step is one aggregate of gradient and Hessian at the current weights."""
    rows = df.dropna(subset=[*x, y]).withColumn("_one", F.lit(1.0))
    names = ["_one", *x]
    w = np.zeros(len(names))
    mean = rows.agg(F.avg(y)).first()[0]
    w[0] = np.log(mean) if mean and mean > 0 else 0.0
    for _ in range(rounds):
        rate = F.exp(F.least(predict(w, names), F.lit(50.0)))
        at = rows.withColumn("_r", rate)
        cells = [F.sum(F.col("_r") * F.col(a) * F.col(b)) for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
        got = list(at.agg(*(F.sum((F.col(y) - F.col("_r")) * F.col(a)) for a in names), *cells).first())
        grad, upper = np.array(got[: len(names)]), iter(got[len(names) :])
        hess = np.zeros((len(names), len(names)))
        for i in range(len(names)):
            for j in range(i, len(names)):
                hess[i, j] = hess[j, i] = next(upper)
        penalty = reg * np.diag([0.0] + [1.0] * len(x))
        step = np.linalg.solve(hess + penalty + 1e-12 * np.eye(len(names)), grad - penalty @ w)
        w = w + step
        if np.abs(step).max() < tolerance:
            break
    return w


def logistic_glm(df: DataFrame, x: Sequence[str], y: str, reg: float = 1e-9, rounds: int = 30) -> np.ndarray:
    """Weights (constant first) of a Bernoulli model, by Newton steps of one aggregate each."""
    rows = df.dropna(subset=[*x, y]).withColumn("_one", F.lit(1.0))
    names = ["_one", *x]
    w = np.zeros(len(names))
    for _ in range(rounds):
        at = rows.withColumn("_p", 1 / (1 + F.exp(-predict(w, names))))
        v = F.col("_p") * (1 - F.col("_p"))
        pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
        got = list(at.agg(*(F.sum((F.col(y) - F.col("_p")) * F.col(a)) for a in names), *(F.sum(v * F.col(names[i]) * F.col(names[j])) for i, j in pairs)).first())
        hess = np.zeros((len(names), len(names)))
        for (i, j), h in zip(pairs, got[len(names) :], strict=True):
            hess[i, j] = hess[j, i] = h
        step = np.linalg.solve(hess + reg * np.eye(len(names)), np.array(got[: len(names)]) - reg * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def power_law(df: DataFrame, x: str, y: str, weight: str) -> DataFrame:
    """Weighted line through logarithms: (slope, intercept)."""
    a, b, w = F.log(x), F.log(y), F.col(weight)
    s = df.where((F.col(x) > 0) & (F.col(y) > 0)).agg(F.sum(w).alias("w"), F.sum(w * a).alias("a"), F.sum(w * b).alias("b"), F.sum(w * a * a).alias("aa"), F.sum(w * a * b).alias("ab"))
    slope = (F.col("ab") * F.col("w") - F.col("a") * F.col("b")) / (F.col("aa") * F.col("w") - F.col("a") * F.col("a"))
    return s.select(slope.alias("slope"), ((F.col("b") - slope * F.col("a")) / F.col("w")).alias("intercept"))


def two_class_poisson(df: DataFrame, count: str, rounds: int = 50) -> tuple[float, float, float]:
    """Rates of two Poisson classes and the share of the larger, by hard assignment from the median.

    Classes are parted where the two log-likelihoods meet; each round is one aggregate."""
    cut = df.agg(F.median(count)).first()[0]
    found = None
    for _ in range(rounds):
        high = F.col(count) > cut
        a, b, share = df.agg(F.avg(F.when(~high, F.col(count))), F.avg(F.when(high, F.col(count))), F.avg(high.cast("double"))).first()
        if a is None or b is None:
            break
        now = (a, b, share)
        if now == found:
            break
        found = now
        tiny = 1e-9
        cut = ((b - a) + np.log((1 - share + tiny) / (share + tiny))) / np.log((b + tiny) / (a + tiny))
    return found
