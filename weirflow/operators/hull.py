"""Convex hulls of point sets of any size: the hull of each part, then of the hulls."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

#: Points that a task holds for a set before it reduces them to their hull.
HELD = 8192


def corners(p: np.ndarray) -> np.ndarray:
    """Corners of the hull of (n, 2) points, counter-clockwise from the smallest (x, y); points on an edge are none."""
    p = np.unique(p[np.isfinite(p).all(axis=1)], axis=0)
    if len(p) < 3:
        return p

    def half(points: list[list[float]]) -> list[list[float]]:
        out: list[list[float]] = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    rows = p.tolist()
    return np.array(half(rows) + half(rows[::-1]))


def hulls(points: DataFrame, by: str, x: str = "x", y: str = "y") -> DataFrame:
    """(by, i, x, y): the hull's corners of each set, counter-clockwise from 0. Rows with a null are left out.

    Each task keeps the hull of what it has read of a set, so a hot set is spread over all tasks and only hulls meet."""
    rows = points.select(F.col(by).alias("s"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    kind = dict(rows.dtypes)["s"]

    def parts(batches):
        held: dict = {}
        sizes: dict = {}
        for batch in batches:
            for s, group in batch.groupby("s", sort=False):
                held.setdefault(s, []).append(group[["x", "y"]].to_numpy())
                sizes[s] = sizes.get(s, 0) + len(group)
                if sizes[s] > HELD:
                    held[s] = [corners(np.concatenate(held[s]))]
                    sizes[s] = len(held[s][0])
        for s, found in held.items():
            p = corners(np.concatenate(found))
            yield pd.DataFrame({"s": pd.Series([s] * len(p), dtype=object), "x": p[:, 0], "y": p[:, 1]})

    def whole(group: pd.DataFrame) -> pd.DataFrame:
        p = corners(group[["x", "y"]].to_numpy())
        return pd.DataFrame({"s": pd.Series([group["s"].iloc[0]] * len(p), dtype=object), "i": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1]})

    made = rows.mapInPandas(parts, f"s {kind}, x double, y double").groupBy("s").applyInPandas(whole, f"s {kind}, i long, x double, y double")
    return made.withColumnRenamed("s", by)


def mask_hulls(grid: DataFrame, by: str, value: str = "value") -> DataFrame:
    """Hulls of the cells of a grid (row, col) that are true, x being the column and y the row."""
    return hulls(grid.where(F.col(value).cast("boolean")), by, "col", "row")


def edges(hull: DataFrame, by: str) -> DataFrame:
    """(by, x, y, next_x, next_y): each corner with the one after it."""
    order = Window.partitionBy(by).orderBy("i")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follows = lambda c: F.coalesce(F.lead(c).over(order), F.first(c).over(whole))
    return hull.select(by, "x", "y", follows("x").alias("next_x"), follows("y").alias("next_y"))


def resampled(hull: DataFrame, by: str, n: int = 60, smooth: float | None = None) -> DataFrame:
    """(by, i, x, y): the hull's distance from its corners' mean at `n` even angles from -pi, linear between corners.

    `smooth` degrees, if given, is the width of a circular Gaussian over those distances. A hull is small by then."""
    if n < 4:
        raise ValueError("at least 4 angles")
    if smooth is not None and (not 0 < smooth <= 360 or n < 30):
        raise ValueError("smoothing takes 0 to 360 degrees and at least 30 angles")
    kind = dict(hull.dtypes)[by]

    def one(group: pd.DataFrame) -> pd.DataFrame:
        z = group["x"].to_numpy() + 1j * group["y"].to_numpy()
        c = z.mean()
        w = z - c
        order = np.argsort(np.angle(w))
        at, r = np.angle(w)[order], np.abs(w)[order]
        angles = np.linspace(-np.pi, np.pi, n + 1)[:-1]
        r = np.interp(angles, np.concatenate([[at[-1] - 2 * np.pi], at, [at[0] + 2 * np.pi]]), np.concatenate([[r[-1]], r, [r[0]]]))
        if smooth is not None:
            turns = np.fft.rfftfreq(n) * n
            # a Gaussian's transform at whole numbers of waves around the circle
            r = np.fft.irfft(np.fft.rfft(r) * np.exp(-0.5 * (turns * np.radians(smooth)) ** 2), n)
        made = c + r * np.exp(1j * angles)
        return pd.DataFrame({by: [group[by].iloc[0]] * n, "i": np.arange(n), "x": made.real, "y": made.imag})

    return hull.groupBy(by).applyInPandas(one, f"{by} {kind}, i long, x double, y double")
