"""Linear filters between channels of sampled series: lag products, block-Toeplitz fits, spectral fits, application.

A series of any length is dealt in chunks that also hold the samples next to them, so every kernel sees all it needs
and holds one chunk of all channels. Lag products and cross-spectra are sums over chunks, whose size is that of the
model; filters are fitted from them and applied chunk by chunk, which gives what the whole series would.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.joins import same_join

#: Samples of a chunk.
LENGTH = 4096


@dataclass(frozen=True)
class Layout:
    """Names of the columns: series, channel, whole sample number and value. Absent samples are zero."""

    trial: str = "trial"
    channel: str = "channel"
    t: str = "t"
    value: str = "value"


def channels(df: DataFrame, at: Layout = Layout()) -> list:
    """The channels in order. They are as many as the model has, so they fit the driver."""
    return [r[0] for r in df.select(at.channel).where(F.col(at.channel).isNotNull()).distinct().orderBy(at.channel).collect()]


def chunks(df: DataFrame, names: Sequence, left: int, right: int, length: int = LENGTH, at: Layout = Layout()) -> DataFrame:
    """(trial, chunk, first, last, cs, ts, vs): samples by chunk, with `left` samples before it and `right` after.

    Arrays hold channel numbers, sample numbers and values; those of other channels than `names` are not sent. `first`
    and `last` bound the series by the samples of all channels; every chunk between them has a row."""
    if length < max(left, right, 1):
        raise ValueError("a chunk must be as long as what it sees of its neighbours")
    number = F.array_position(F.array(*map(F.lit, names)), F.col(at.channel)).cast("int") - 1
    rows = df.select(F.col(at.trial).alias("trial"), number.alias("c"), F.col(at.t).cast("long").alias("t"), F.col(at.value).cast("double").alias("v"))
    ends = rows.where("t is not null").groupBy("trial").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    rows = rows.where("c >= 0 and t is not null and v is not null")
    own = F.floor(F.col("t") / F.lit(length)).cast("long")
    inside = F.col("t") - own * length
    near = F.array_compact(F.array(own, F.when(inside >= length - left, own + 1), F.when(inside < right, own - 1)))
    dealt = rows.withColumn("chunk", F.explode(near))
    dealt = dealt.groupBy("trial", "chunk").agg(*(F.collect_list(c).alias(f"{c}s") for c in "ctv"))
    every = ends.select("*", F.explode(F.sequence(F.floor(F.col("first") / length).cast("long"), F.floor(F.col("last") / length).cast("long"))).alias("chunk"))
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return same_join(every, dealt, ["trial", "chunk"], "left").select("trial", "chunk", "first", "last", none("cs", "array<int>"), none("ts", "array<long>"), none("vs", "array<double>"))


def _matrix(row: dict, n: int, means: np.ndarray, left: int, right: int, length: int) -> tuple[np.ndarray, int, int]:
    """Channels by samples of a chunk with its neighbours, less the means and zero beyond the series; and the part of
    the chunk that the series covers."""
    begin = row["chunk"] * length - left
    x = np.zeros((n, left + length + right))
    np.add.at(x, (row["cs"], np.asarray(row["ts"]) - begin), row["vs"])
    a, b = max(0, row["first"] - begin), min(x.shape[1], row["last"] + 1 - begin)
    x[:, a:b] -= means[:, None]
    x[:, :a], x[:, b:] = 0, 0
    return x, max(a, left), min(b, left + length)


def _rows(batch: pa.RecordBatch):
    columns = {c: batch.column(c) for c in ("chunk", "first", "last")}
    lists = {c: batch.column(c) for c in ("cs", "ts", "vs")}
    for i in range(batch.num_rows):
        yield {c: v[i].as_py() for c, v in columns.items()} | {c: v[i].values.to_numpy(zero_copy_only=False) for c, v in lists.items()}


def channel_means(df: DataFrame, names: Sequence, at: Layout = Layout()) -> np.ndarray:
    """Mean of each channel over all samples of all series, absent ones being zero."""
    span = df.where(F.col(at.t).isNotNull()).groupBy(at.trial).agg((F.max(at.t) - F.min(at.t) + 1).alias("n")).agg(F.sum("n")).first()[0] or 1
    sums = {r[0]: r[1] or 0.0 for r in df.groupBy(at.channel).agg(F.sum(F.col(at.value).cast("double"))).collect()}
    return np.array([sums.get(n, 0.0) / span for n in names])


def lag_products(df: DataFrame, names: Sequence, most: int, means: np.ndarray | None = None, length: int = LENGTH, at: Layout = Layout()) -> np.ndarray:
    """(channels, channels, most + 1): for lag d, the sum over all series of x_u[t - d] x_v[t], less the means.

    Each task sends one number for each pair and lag."""
    n = len(names)
    means = np.zeros(n) if means is None else means
    length = max(length, most, 1)

    def run(batches):
        out = np.zeros((n, n, most + 1))
        for batch in batches:
            for row in _rows(batch):
                x, _, _ = _matrix(row, n, means, most, 0, length)
                now = x[:, most:]
                for d in range(most + 1):
                    out[:, :, d] += x[:, most - d : most - d + length] @ now.T
        u, v, d = (a.ravel() for a in np.indices(out.shape))
        yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int32()), "v": pa.array(v, pa.int32()), "lag": pa.array(d, pa.int32()), "product": pa.array(out.ravel())})

    made = chunks(df, names, most, 0, length, at).drop("trial").mapInArrow(run, "u int, v int, lag int, product double")
    got = made.groupBy("u", "v", "lag").agg(F.sum("product").alias("product")).toPandas()
    out = np.zeros((n, n, most + 1))
    out[got["u"], got["v"], got["lag"]] = got["product"]
    return out


@dataclass(frozen=True)
class Filters:
    """target[t] = mean + sum over inputs and lags of weights[input, lag - first] (input[t - lag] - its mean)."""

    inputs: tuple
    first: int
    weights: np.ndarray
    means: np.ndarray
    target_mean: float

    @property
    def last(self) -> int:
        return self.first + self.weights.shape[1] - 1


def _lagged(c: np.ndarray, u: int, v: int, d: int) -> float:
    """Sum of x_u[s] x_v[s + d] for a lag of either sign."""
    return c[u, v, d] if d >= 0 else c[v, u, -d]


def fit(df: DataFrame, target, first: int, last: int, reg: float = 0.0, length: int = LENGTH, at: Layout = Layout()) -> Filters:
    """Least squares filters of all other channels onto `target`, for lags from `first` to `last`.

    The normal matrix is one Toeplitz block for each pair of channels, made of lag products; its size is channels
    times lags, squared. `reg` is a ridge relative to its mean diagonal."""
    if last < first:
        raise ValueError("no lag")
    every = channels(df, at)
    names = [c for c in every if c != target]
    if target not in every or not names:
        raise ValueError("a target and an input are needed")
    means = channel_means(df, [*names, target], at)
    k = last - first + 1
    c = lag_products(df, [*names, target], max(k - 1, abs(first), abs(last)), means, length, at)
    n = len(names)
    lags = np.arange(first, last + 1)
    a = np.array([[_lagged(c, u, v, int(l - m)) for v in range(n) for m in lags] for u in range(n) for l in lags])
    b = np.array([_lagged(c, u, n, int(l)) for u in range(n) for l in lags])
    ridge = reg * max(np.trace(a) / len(a), 1e-300) * np.eye(len(a))
    w = np.linalg.lstsq(a + ridge, b, rcond=None)[0]
    return Filters(tuple(names), first, w.reshape(n, k), means[:n], float(means[n]))


def spectral_fit(df: DataFrame, target, size: int = 256, reg: float = 0.0, at: Layout = Layout()) -> Filters:
    """Filters from cross-spectra: at each frequency, least squares of the target's on the inputs' Fourier terms.

    Spectra are averaged over windows of `size` samples, half overlapping, Hann weighted; the filters run over lags from
    -size / 2 to size / 2 - 1. Windows that the series covers in part are zero beyond it."""
    every = channels(df, at)
    names = [c for c in every if c != target]
    if target not in every or not names or size < 4 or size % 2:
        raise ValueError("a target, an input and an even size are needed")
    both = [*names, target]
    means, n, half = channel_means(df, both, at), len(both), size // 2
    taper = np.hanning(size + 1)[:size]

    def run(batches):
        out = np.zeros((n, n, half + 1), complex)
        for batch in batches:
            for row in _rows(batch):
                x, _, _ = _matrix(row, n, means, 0, half, half)
                f = np.fft.rfft(x * taper, axis=1)
                out += np.einsum("uf,vf->uvf", f.conj(), f)
        u, v, k = (a.ravel() for a in np.indices(out.shape))
        yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int32()), "v": pa.array(v, pa.int32()), "k": pa.array(k, pa.int32()), "re": pa.array(out.real.ravel()), "im": pa.array(out.imag.ravel())})

    made = chunks(df, both, 0, half, half, at).drop("trial").mapInArrow(run, "u int, v int, k int, re double, im double")
    got = made.groupBy("u", "v", "k").agg(F.sum("re").alias("re"), F.sum("im").alias("im")).toPandas()
    s = np.zeros((n, n, half + 1), complex)
    s[got["u"], got["v"], got["k"]] = got["re"] + 1j * got["im"]
    scale = np.abs(np.trace(s[:-1, :-1].sum(axis=2))) / ((n - 1) * (half + 1))
    response = np.array([np.linalg.lstsq(s[:-1, :-1, k] + reg * scale * np.eye(n - 1), s[:-1, -1, k], rcond=1e-12)[0] for k in range(half + 1)])
    w = np.fft.fftshift(np.fft.irfft(response.T, size, axis=1), axes=1)
    return Filters(tuple(names), -half, w, means[:-1], float(means[-1]))


def apply(df: DataFrame, model: Filters, length: int = LENGTH, at: Layout = Layout()) -> DataFrame:
    """(trial, t, fitted) for every sample number between a series' ends, from the inputs alone.

    Inputs before the first sample and after the last are taken to be at their means."""
    left, right = max(model.last, 0), max(-model.first, 0)
    length = max(length, left, right, 1)
    n, k = model.weights.shape
    size = 1 << (left + length + right + k - 2).bit_length()
    spectrum = np.fft.rfft(model.weights, size, axis=1)

    def run(batches):
        for batch in batches:
            for i, row in enumerate(_rows(batch)):
                x, a, b = _matrix(row, n, model.means, left, right, length)
                if b <= a:
                    continue
                y = np.fft.irfft((np.fft.rfft(x, size, axis=1) * spectrum).sum(axis=0), size)
                t = np.arange(a, b)
                yield pa.RecordBatch.from_arrays([batch.column("trial").take(pa.array(np.full(len(t), i))), pa.array(t + row["chunk"] * length - left, pa.int64()), pa.array(y[t - model.first] + model.target_mean)], names=["trial", "t", "fitted"])

    held = chunks(df, model.inputs, left, right, length, at)
    return held.mapInArrow(run, f"trial {dict(held.dtypes)['trial']}, t long, fitted double")
