"""Recursions along series: state that is carried over sorted rows, forwards or backwards.

Rows of a series come to a task in order and in Arrow batches; a kernel gets a run of them and the state so far. So a
worker holds a batch and a state, whatever the length of the series. What needs both directions writes the forward
pass to the checkpoint folder and reads it backwards.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.store import checkpoint_folder

#: Of (state, or None at a series' first row; arrays by column): arrays by output column, and the state after them.
Step = Callable[[Any, dict[str, np.ndarray]], tuple[dict[str, Any], Any]]
#: Of a number of series: arrays of their state before the first row.
Begin = Callable[[int], tuple[np.ndarray, ...]]
#: Of (states, one row of each series by column, which of them begin): arrays by output column, and the states after.
Steps = Callable[[tuple[np.ndarray, ...], dict[str, np.ndarray], np.ndarray], tuple[dict[str, np.ndarray], tuple[np.ndarray, ...]]]


def scan(df: DataFrame, by: str, i: str, values: Sequence[str], step: Step, outputs: str, carry: Sequence[str] = (), reverse: bool = False) -> DataFrame:
    """(by, i, carry, outputs): `step` along each series in order of `i`, or against it.

    `values` reach the step as numpy arrays, nulls of numbers as NaN, arrays as arrays of arrays; columns of `carry`
    pass by. Rows without `i` are left out; a null `by` is a series; equal `i` follow one another in any order."""
    rows, names, kinds = _in_order(df, by, i, values, carry, reverse)

    def run(batches):
        key, state, begun = None, None, False
        for batch in batches:
            keys, cuts = _cuts(batch.column(by))
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if not begun or keys[a] != key:
                    key, state, begun = keys[a], None, True
                part = batch.slice(a, b - a)
                got = {v: _numpy(part.column(v)) for v in values}
                out, state = step(state, got)
                yield pa.RecordBatch.from_arrays([part.column(n) for n in names] + [x if isinstance(x, pa.Array) else pa.array(x, from_pandas=True) for x in out.values()], names=names + list(out))

    made = rows.mapInArrow(run, ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", " + outputs)
    return made


def _in_order(df: DataFrame, by: str, i: str, values: Sequence[str], carry: Sequence[str], reverse: bool) -> tuple[DataFrame, list[str], dict[str, str]]:
    """Rows of series in order, each series in one partition; the columns that pass by; and the types."""
    rows = df.where(F.col(i).isNotNull()).select(*dict.fromkeys([by, i, *carry, *values]))
    rows = rows.repartition(by).sortWithinPartitions(by, F.col(i).desc() if reverse else F.col(i).asc())
    return rows, [by, i, *carry], dict(rows.dtypes)


def _cuts(column: pa.Array) -> tuple[list, list[int]]:
    """Keys of a batch, and where its series begin and the last one ends."""
    keys = column.to_pylist()
    return keys, [0, *(n for n in range(1, len(keys)) if keys[n] != keys[n - 1]), len(keys)]


def together(df: DataFrame, by: str, i: str, values: Sequence[str], begin: Begin, step: Steps, outputs: str, carry: Sequence[str] = (), reverse: bool = False) -> DataFrame:
    """As `scan`, the series of a batch side by side: their first rows at once, then their second ones, and so on.

    So numpy is called as often as the longest series of a batch has rows. Arrays of a column are of one length and
    reach the step as matrices; NaN comes out as null."""
    rows, names, kinds = _in_order(df, by, i, values, carry, reverse)

    def run(batches):
        key, kept = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, cuts = _cuts(batch.column(by))
            starts, sizes = np.array(cuts[:-1]), np.diff(cuts)
            state, fresh = begin(len(starts)), np.ones(len(starts), bool)
            if kept is not None and keys[0] == key:
                fresh[0] = False
                for s, x in zip(state, kept, strict=True):
                    s[0] = x
            got = {v: _matrix(batch.column(v)) for v in values}
            # long series first, so that those that still go on are the first ones
            order = np.argsort(-sizes, kind="stable")
            state, fresh, starts, sizes = tuple(s[order] for s in state), fresh[order], starts[order], sizes[order]
            out: dict[str, np.ndarray] = {}
            for k in range(sizes[0]):
                n = int(np.searchsorted(-sizes, -k, "left"))
                at = starts[:n] + k
                made, after = step(tuple(s[:n] for s in state), {v: x[at] for v, x in got.items()}, fresh[:n])
                for s, x in zip(state, after, strict=True):
                    s[:n] = x
                fresh[:n] = False
                for c, x in made.items():
                    if c not in out:
                        out[c] = np.empty((len(keys), *x.shape[1:]), x.dtype)
                    out[c][at] = x
            last = int(np.flatnonzero(order == len(order) - 1)[0])
            key, kept = keys[-1], tuple(s[last].copy() for s in state)
            arrays = [_lists(x) if x.ndim > 1 else pa.array(x, from_pandas=True) for x in out.values()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *arrays], names=names + list(out))

    return rows.mapInArrow(run, ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", " + outputs)


def _matrix(column: pa.Array) -> np.ndarray:
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return column.to_numpy(zero_copy_only=False)


def _numpy(column: pa.Array) -> np.ndarray:
    if pa.types.is_list(column.type):
        out = np.empty(len(column), object)
        out[:] = [None if v is None else np.asarray(v, float) for v in column.to_pylist()]
        return out
    return column.to_numpy(zero_copy_only=False)


def _lists(rows: np.ndarray) -> pa.Array:
    """(n, ...) numbers as an array of flat lists."""
    flat = np.ascontiguousarray(rows, float).reshape(len(rows), -1)
    return pa.ListArray.from_arrays(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1], pa.array(flat.ravel()))


def exponential_average(df: DataFrame, by: str, i: str, x: str, keep: float, to: str, carry: Sequence[str] = ()) -> DataFrame:
    """keep times the average so far plus the rest of the value, begun with the first value; nulls change nothing."""

    def step(state, got):
        out = np.empty(len(got[x]))
        for n, v in enumerate(got[x].astype(float).tolist()):
            if v == v:
                state = v if state is None else keep * state + (1 - keep) * v
            out[n] = np.nan if state is None else state
        return {to: out}, state

    return scan(df, by, i, [x], step, f"{to} double", carry)


def viterbi(df: DataFrame, by: str, i: str, x: str, loglike: Callable[[np.ndarray], np.ndarray], transition: np.ndarray, initial: np.ndarray) -> DataFrame:
    """(by, i, state): the most likely path; `loglike` makes (rows, states) of values."""
    checkpoint_folder(df.sparkSession)
    logt, log0 = np.log(transition + 1e-300), np.log(initial + 1e-300)

    def forward(best, got):
        like = loglike(got[x].astype(float))
        back, top = np.zeros(like.shape), np.zeros(len(like), int)
        for n in range(len(like)):
            if best is None:
                best = log0 + like[n]
            else:
                ways = best[:, None] + logt
                back[n] = ways.argmax(axis=0)
                best = ways.max(axis=0) + like[n]
            best = best - best.max()
            top[n] = best.argmax()
        return {"back": _lists(back), "top": pa.array(top)}, best

    def backward(state, got):
        out = np.empty(len(got["top"]), int)
        for n in range(len(out)):
            out[n] = got["top"][n] if state is None else state
            state = int(got["back"][n][out[n]])
        return {"state": out}, state

    made = scan(df, by, i, [x], forward, "back array<double>, top long").checkpoint()
    return scan(made, by, i, ["back", "top"], backward, "state long", reverse=True)


def posteriors(df: DataFrame, by: str, i: str, x: str, loglike: Callable[[np.ndarray], np.ndarray], transition: np.ndarray, initial: np.ndarray) -> DataFrame:
    """(by, i, posterior, gain): probabilities of the states given the whole series, and each row's log-likelihood given
    those before it; the gains of a series sum up to its own."""
    checkpoint_folder(df.sparkSession)

    def forward(state, got):
        logs = loglike(got[x].astype(float))
        tops = logs.max(axis=1)
        like = np.exp(logs - tops[:, None])
        ahead, gain = np.empty(like.shape), np.empty(len(like))
        for n in range(len(like)):
            now = (initial if state is None else state @ transition) * like[n]
            total = now.sum()
            ahead[n] = state = now / total
            gain[n] = np.log(total) + tops[n]
        return {"ahead": _lists(ahead), "like": _lists(like), "gain": pa.array(gain)}, state

    def backward(state, got):
        # state: what the rows after this one say of each state, up to a factor
        out = np.empty((len(got["ahead"]), len(initial)))
        for n, (ahead, like) in enumerate(zip(got["ahead"], got["like"], strict=True)):
            back = np.ones(len(initial)) if state is None else state
            now = ahead * back
            out[n] = now / now.sum()
            back = transition @ (back * like)
            state = back / back.sum()
        return {"posterior": _lists(out)}, state

    made = scan(df, by, i, [x], forward, "ahead array<double>, like array<double>, gain double").checkpoint()
    return scan(made, by, i, ["ahead", "like"], backward, "posterior array<double>", ["gain"], reverse=True)


def kalman(df: DataFrame, by: str, i: str, measured: Sequence[str], a: np.ndarray, b: np.ndarray, q: np.ndarray, r: np.ndarray, m0: np.ndarray | None = None, c0: np.ndarray | None = None) -> DataFrame:
    """(by, i, mean, cov): states given all measurements y = b x + noise(r), x' = a x + noise(q); cov is flat.

    Rows with a null measurement only pass time. The first state has mean `m0`, or what the first measurement says if
    none is given, and covariance `c0`."""
    checkpoint_folder(df.sparkSession)
    d = len(a)
    c0 = np.eye(d) * 1e6 if c0 is None else c0

    def forward(state, got):
        y = np.stack([got[c].astype(float) for c in measured], axis=1)
        pm, pc, fm, fc = np.empty((len(y), d)), np.empty((len(y), d, d)), np.empty((len(y), d)), np.empty((len(y), d, d))
        for n, now in enumerate(y):
            known = np.isfinite(now).all()
            if state is None:
                m, c = (m0 if m0 is not None else np.linalg.lstsq(b, now, rcond=None)[0] if known else np.zeros(d)), c0
            else:
                m, c = a @ state[0], a @ state[1] @ a.T + q
            pm[n], pc[n] = m, c
            if known:
                gain = c @ b.T @ np.linalg.inv(b @ c @ b.T + r)
                m, c = m + gain @ (now - b @ m), c - gain @ b @ c
            fm[n], fc[n], state = m, c, (m, c)
        return {"pm": _lists(pm), "pc": _lists(pc), "fm": _lists(fm), "fc": _lists(fc)}, state

    made = scan(df, by, i, measured, forward, "pm array<double>, pc array<double>, fm array<double>, fc array<double>").checkpoint()
    return _smoothed(made, by, i, a)


def _smoothed(made: DataFrame, by: str, i: str, a: np.ndarray, carry: Sequence[str] = ()) -> DataFrame:
    """(by, i, carry, mean, cov): the way back over filtered moments (fm, fc) and those foreseen (pm, pc)."""
    d = len(a)

    def begin(n):
        return np.zeros((n, d)), np.zeros((n, d, d)), np.zeros((n, d)), np.tile(np.eye(d), (n, 1, 1))

    def backward(state, got, fresh):
        later, spread, foreseen, width = state
        fm, pm, fc, pc = got["fm"], got["pm"], got["fc"].reshape(-1, d, d), got["pc"].reshape(-1, d, d)
        back = fc @ a.T @ np.linalg.inv(width)
        m = fm + (back @ (later - foreseen)[:, :, None])[:, :, 0]
        c = fc + back @ (spread - width) @ back.transpose(0, 2, 1)
        m, c = np.where(fresh[:, None], fm, m), np.where(fresh[:, None, None], fc, c)
        return {"mean": m, "cov": c}, (m, c, pm, pc)

    return together(made, by, i, ["pm", "pc", "fm", "fc"], begin, backward, "mean array<double>, cov array<double>", carry, reverse=True)


def linear_filter(df: DataFrame, by: str, i: str, x: str, a: np.ndarray, c: np.ndarray, start: np.ndarray) -> DataFrame:
    """(by, i, z): causal z += a z + c x from `start`; null values count as zero."""

    def step(state, got):
        z, out = (start if state is None else state).astype(float), np.empty((len(got[x]), len(start)))
        for n, v in enumerate(np.nan_to_num(got[x].astype(float))):
            z = z + a @ z + c * v
            out[n] = z
        return {"z": _lists(out)}, z

    return scan(df, by, i, [x], step, "z array<double>")


@dataclass(frozen=True)
class Walk:
    """A hidden value that keeps the share `keep` of its distance from `mean` and gets noise of variance `noise` each
    step; `start` and `spread` are the first value's mean and variance. `keep` = 1 diffuses."""

    keep: float = 1.0
    noise: float = 1.0
    mean: float = 0.0
    start: float = 0.0
    spread: float = 1.0


def _log_rate(y, x, a, b):
    return y * (a * x + b) - np.exp(np.minimum(a * x + b, 700))


def _rate(y, x, a, b):
    rate = np.maximum(a * x + b, 1e-12)
    return y * np.log(rate) - rate


def _square_rate(y, x, a, b):
    rate = np.maximum((a * x + b) ** 2, 1e-12)
    return y * np.log(rate) - rate


def _chance(y, x, a, b):
    return y * (a * x + b) - np.logaddexp(0, a * x + b)


def _few(y, x, a, b):
    s = np.minimum(a * x + b, 300)
    return y * s - np.log1p(np.exp(s) + 0.5 * np.exp(2 * s))


#: log-likelihood, up to a constant, of a count or a yes given the hidden value: counts of rate exp(a x + b), a x + b or
#: (a x + b)^2, yes by the logistic of a x + b, counts of 0 to 2 of rate exp(a x + b).
OBSERVED = {"log": _log_rate, "linear": _rate, "square": _square_rate, "logistic": _chance, "truncated": _few}


def moments(loglike: Callable[[np.ndarray], np.ndarray], m: float, v: float, points: int = 201, reach: float = 8.0) -> tuple[float, float, float]:
    """Mean, variance and log normaliser of a normal density times a likelihood.

    A grid over the normal's `reach` finds where the product lies; a second one over that part gives the moments."""
    mean, var, log = all_moments(lambda x, _: loglike(x), np.array([m], float), np.array([v], float), points, reach)
    return float(mean[0]), float(var[0]), float(log[0])


def all_moments(loglike: Callable[[np.ndarray, np.ndarray], np.ndarray], m: np.ndarray, v: np.ndarray, points: int = 201, reach: float = 8.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for several densities; `loglike` gets places (densities, points) and the numbers of these densities."""
    low, high = m - reach * np.sqrt(v), m + reach * np.sqrt(v)
    mean, var, log, going = np.empty(len(m)), np.empty(len(m)), np.empty(len(m)), np.arange(len(m))
    for _ in range(4):
        a, z = low[going], high[going]
        x = np.linspace(a, z, points, axis=-1)
        logs = loglike(x, going) - 0.5 * (x - m[going, None]) ** 2 / v[going, None]
        top = logs.max(axis=1)
        p = np.exp(logs - top[:, None])
        total = p.sum(axis=1)
        now = (p * x).sum(axis=1) / total
        spread = (p * (x - now[:, None]) ** 2).sum(axis=1) / total
        mean[going], var[going] = now, np.maximum(spread, 1e-300)
        log[going] = np.log(total * (x[:, 1] - x[:, 0])) + top - 0.5 * np.log(2 * np.pi * v[going])
        narrow = reach * np.sqrt(np.maximum(spread, ((z - a) / points) ** 2))
        more = 2 * narrow < 0.75 * (z - a)
        low[going], high[going] = np.maximum(a, now - narrow), np.minimum(z, now + narrow)
        going = going[more]
        if not len(going):
            break
    return mean, var, log


def density_filter(df: DataFrame, by: str, i: str, y: str, walk: Walk, observed: str = "log", gain: float = 1.0, bias: float = 0.0) -> DataFrame:
    """(by, i, pm, pc, fm, fc, evidence): a normal belief in the hidden value of a walk, before and after each count.

    The belief after a count is the normal density with the moments of belief times likelihood. Null counts only pass
    time. Moments are arrays of one number; evidence is the log-likelihood of the count (up to a constant) given those before."""
    like = OBSERVED[observed]

    def step(state, got, fresh):
        m = np.where(fresh, walk.start, walk.mean + walk.keep * (state[0] - walk.mean))
        v = np.where(fresh, walk.spread, walk.keep**2 * state[1] + walk.noise)
        count, fm, fv, said = got[y].astype(float), m.copy(), v.copy(), np.zeros(len(m))
        known = np.flatnonzero(count == count)
        if len(known):
            fm[known], fv[known], said[known] = all_moments(lambda x, which: like(count[known[which], None], x, gain, bias), m[known], v[known])
        return {"pm": m[:, None], "pc": v[:, None], "fm": fm[:, None], "fc": fv[:, None], "evidence": said}, (fm, fv)

    return together(df, by, i, [y], lambda n: (np.zeros(n), np.zeros(n)), step, "pm array<double>, pc array<double>, fm array<double>, fc array<double>, evidence double")


def density_smoother(df: DataFrame, by: str, i: str, y: str, walk: Walk, observed: str = "log", gain: float = 1.0, bias: float = 0.0) -> DataFrame:
    """(by, i, mean, var, evidence): the hidden value given all counts of the series."""
    checkpoint_folder(df.sparkSession)
    made = density_filter(df, by, i, y, walk, observed, gain, bias).checkpoint()
    return _smoothed(made, by, i, np.array([[walk.keep]]), ["evidence"]).select(by, i, F.col("mean")[0].alias("mean"), F.col("cov")[0].alias("var"), "evidence")


def laplace_poisson(m: np.ndarray, c: np.ndarray, b: np.ndarray, y: float, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Peak, and covariance there, of a normal density times the likelihood of a count of rate exp(b x), by Newton steps.

    Only the direction c b matters, so the steps are along one number: x = m + c b s."""
    mean, cov = laplace_poissons(m[None], c[None], b, np.array([y], float), rounds)
    return mean[0], cov[0]


def laplace_poissons(m: np.ndarray, c: np.ndarray, b: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """The same for several densities, a count each."""
    cb = c @ b
    spread, base, s = cb @ b, m @ b, np.zeros(len(y))
    most = 1 / np.maximum(spread, 1e-300)
    going = np.ones(len(y), bool)
    for _ in range(rounds):
        rate = np.exp(np.minimum(base + spread * s, 700.0))
        # s = y - rate at the peak; the function is convex, steps are held to one unit of log rate
        move = np.where(going, np.clip((s - (y - rate)) / (1 + rate * spread), -most, most), 0.0)
        s -= move
        going &= np.abs(move) * np.maximum(spread, 1.0) >= 1e-12
        if not going.any():
            break
    rate = np.exp(np.minimum(base + spread * s, 700.0))
    return m + cb * s[:, None], c - cb[:, :, None] * cb[:, None, :] * (rate / (1 + rate * spread))[:, None, None]


def laplace_smoother(df: DataFrame, by: str, i: str, y: str, a: np.ndarray, q: np.ndarray, b: np.ndarray, m0: np.ndarray, c0: np.ndarray) -> DataFrame:
    """(by, i, mean, cov): several hidden values x' = a x + noise(q) given counts of rate exp(b x), by peaks and curvatures."""
    checkpoint_folder(df.sparkSession)
    d = len(a)

    def begin(n):
        return np.zeros((n, d)), np.zeros((n, d, d))

    def step(state, got, fresh):
        m = np.where(fresh[:, None], m0, state[0] @ a.T)
        c = np.where(fresh[:, None, None], c0, a @ state[1] @ a.T + q)
        count, fm, fc = got[y].astype(float), m.copy(), c.copy()
        known = count == count
        if known.any():
            fm[known], fc[known] = laplace_poissons(m[known], c[known], b, count[known])
        return {"pm": m, "pc": c, "fm": fm, "fc": fc}, (fm, fc)

    made = together(df, by, i, [y], begin, step, "pm array<double>, pc array<double>, fm array<double>, fc array<double>").checkpoint()
    return _smoothed(made, by, i, a)
