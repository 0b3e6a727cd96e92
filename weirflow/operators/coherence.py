"""Coherence of many channels from tapered windows: over all, by trial, by place in the trial, or window by window.

Windows of a series are rows that also hold the samples after them, so long series are spread over tasks. Each task
adds up the cross-spectra of its windows for every group asked for; what meets is channels squared times frequencies.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.spectral import dpss
from .lagmodel import Layout, _matrix, _rows, chunks

#: What is averaged together, by name: the columns that keep windows apart.
GROUPS = {"all": (), "trial": ("trial",), "place": ("chunk",), "window": ("trial", "chunk")}
#: Complex numbers that a task holds before it sends its sums so far.
HELD = 1 << 20


def cross_spectra(df: DataFrame, names: Sequence, size: int, tapers: int = 5, group: str = "all", at: Layout = Layout()) -> DataFrame:
    """(group, u, v, k, re, im, power_u, power_v, n): sums of tapered cross-spectra of channels u <= v at frequency
    k / size, of the power of both, and their number.

    Windows of `size` samples begin every size / 2 samples and lie wholly within their series; each is centred.
    A window has `tapers` spectra. The chunk of a window is its begin over size / 2. A task holds sums of a bounded number of
    groups; single windows are sent as they are and not shuffled again."""
    if size < 4 or size % 2:
        raise ValueError("size is even and at least 4")
    n, half, keep = len(names), size // 2, GROUPS[group]
    weights = dpss(size, (tapers + 1) / 2, tapers)
    u, v = np.triu_indices(n)
    zero = np.zeros(n)
    held = chunks(df, names, 0, half, half, at)
    kind = dict(held.dtypes)["trial"]

    most = max(1, HELD // (n * n * (half + 1)))

    def given(sums: dict[tuple, list], trial_type: pa.DataType) -> pa.RecordBatch:
        m, count = len(u) * (half + 1), len(sums)
        s = np.stack([x for x, _ in sums.values()])
        power = np.real(s[:, np.arange(n), np.arange(n)])
        columns = {c: pa.array([key[k] for key in sums], trial_type if c == "trial" else pa.int64()).take(pa.array(np.repeat(np.arange(count), m))) for k, c in enumerate(keep)}
        columns |= {c: pa.array(np.tile(x, count), pa.int32()) for c, x in (("u", np.repeat(u, half + 1)), ("v", np.repeat(v, half + 1)), ("k", np.tile(np.arange(half + 1), len(u))))}
        flat = s[:, u, v].ravel()
        columns |= {"re": pa.array(flat.real), "im": pa.array(flat.imag), "power_u": pa.array(power[:, u].ravel()), "power_v": pa.array(power[:, v].ravel())}
        return pa.RecordBatch.from_pydict(columns | {"n": pa.array(np.repeat([x for _, x in sums.values()], m), pa.int64())})

    def run(batches):
        sums: dict[tuple, list] = {}
        kind_of = None
        for batch in batches:
            trials = batch.column("trial")
            kind_of = trials.type
            for i, row in enumerate(_rows(batch)):
                begin = row["chunk"] * half
                if begin < row["first"] or begin + size - 1 > row["last"]:
                    continue
                x, _, _ = _matrix(row, n, zero, 0, half, half)
                f = np.fft.rfft((x - x.mean(axis=1, keepdims=True))[:, None, :] * weights, axis=2)
                s = np.einsum("utk,vtk->uvk", f, f.conj())
                key = tuple(trials[i].as_py() if c == "trial" else row["chunk"] for c in keep)
                if key in sums:
                    sums[key][0] += s
                    sums[key][1] += tapers
                else:
                    sums[key] = [s, tapers]
                if len(sums) >= most:
                    yield given(sums, kind_of)
                    sums = {}
        if sums:
            yield given(sums, kind_of)

    columns = "".join(f"{c} {kind if c == 'trial' else 'long'}, " for c in keep)
    made = held.mapInArrow(run, columns + "u int, v int, k int, re double, im double, power_u double, power_v double, n long")
    if group == "window":
        return made
    return made.groupBy(*keep, "u", "v", "k").agg(*(F.sum(c).alias(c) for c in ("re", "im", "power_u", "power_v", "n")))


def coherence(spectra: DataFrame, names: Sequence, size: int, rate: float = 1.0, group: str = "all") -> DataFrame:
    """(group, first, second, frequency, coherence, phase, n, p_value) of all pairs, from `cross_spectra`.

    coherence is the squared magnitude; the p-value is that of one at least as large between unrelated channels."""
    keep = list(GROUPS[group])
    rows = spectra.where("u < v")
    squared = (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / F.nullif(F.col("power_u") * F.col("power_v"), F.lit(0.0))
    named = lambda c: F.element_at(F.array(*map(F.lit, names)), F.col(c) + 1)
    rows = rows.withColumn("coherence", F.least(squared, F.lit(1.0)))
    return rows.select(*keep, named("u").alias("first"), named("v").alias("second"), (F.col("k") * rate / size).alias("frequency"), "coherence", F.atan2("im", "re").alias("phase"), "n", p_value(F.col("coherence"), F.col("n")).alias("p_value"))


def p_value(squared: Column, n: Column) -> Column:
    """Chance of a squared coherence at least as large from n independent spectra of unrelated signals."""
    return F.when(n > 1, F.pow(1 - squared, n - 1))


def corrected(squared: Column, n: Column) -> Column:
    """Squared coherence less what chance gives it, so that unrelated signals have zero on average."""
    return F.when(n > 1, (n * squared - 1) / (n - 1))


def population(spectra: DataFrame, names: Sequence, size: int, rate: float = 1.0, group: str = "all") -> DataFrame:
    """(group, frequency, mean, eigen): mean squared coherence of the pairs, and the largest eigenvalue of the complex
    coherency matrix less one over the number of channels less one: 0 if unrelated, 1 if all are one.

    A group's matrix at a frequency has channels squared numbers."""
    n, keep = len(names), list(GROUPS[group])
    rows = spectra.groupBy(*keep, "k").agg(F.collect_list(F.struct("u", "v", "re", "im")).alias("s"))
    kinds = dict(rows.dtypes)

    def run(batches):
        for batch in batches:
            mean, eigen = [], []
            for s in batch.column("s"):
                s = s.values
                u, v, re, im = (s.field(c).to_numpy(zero_copy_only=False) for c in ("u", "v", "re", "im"))
                m = np.zeros((n, n), complex)
                m[u, v] = re + 1j * im
                m[v, u] = re - 1j * im
                p = np.sqrt(np.maximum(np.real(np.diag(m)), 1e-300))
                m /= np.outer(p, p)
                off = np.abs(m[np.triu_indices(n, 1)]) ** 2
                mean.append(float(off.mean()) if len(off) else None)
                eigen.append(float((np.linalg.eigvalsh(m)[-1] - 1) / (n - 1)) if n > 1 else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), batch.column("k"), pa.array(mean, pa.float64()), pa.array(eigen, pa.float64())], names=[*keep, "k", "mean", "eigen"])

    made = rows.mapInArrow(run, "".join(f"{c} {kinds[c]}, " for c in keep) + "k int, mean double, eigen double")
    return made.select(*keep, (F.col("k") * rate / size).alias("frequency"), "mean", "eigen")


def chance_level(n: int, alpha: float = 0.05) -> float:
    """The squared coherence that unrelated signals exceed with probability alpha."""
    return 1 - math.pow(alpha, 1 / (n - 1)) if n > 1 else 1.0
