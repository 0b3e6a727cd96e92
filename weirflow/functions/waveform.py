"""Widths and times of waveform arrays with a trough, and phases along arrays."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, functions as F


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f uses it."""
    return F.transform(F.array(value), lambda x: f(x))[0]  # noqa: PLW0108


def _at(wave: Column) -> Column:
    """Place of the least value, from 0."""
    return F.array_position(wave, F.array_min(wave)).cast("int") - 1


def crossings(above: Column, step: int) -> Column:
    """Places from 0 after which an array of 0 and 1 goes up (`step` 1) or down (-1)."""
    places = lambda a: F.sequence(F.lit(0), F.greatest(F.size(a) - 2, F.lit(0)))
    return bound(above, lambda a: F.filter(places(a), lambda i: F.get(a, i + 1) - F.get(a, i) == step))


def _between(above: Column, after: Column | None = None, once: bool = True) -> Column:
    """From the first way up to the first way down, both beyond a place; null unless in this order, or there are more."""
    beyond = lambda p: p if after is None else F.filter(p, lambda i: i > after)
    pick = lambda p: F.when(F.size(p) == 1, F.get(p, F.lit(0))) if once else F.get(p, F.lit(0))
    ends = lambda a: F.array(pick(beyond(crossings(a, 1))), pick(beyond(crossings(a, -1))))
    return bound(bound(above, ends), lambda e: F.when(e[0] < e[1], e[1] - e[0]))


def _flags(wave: Column, level: Column, low: bool = False) -> Column:
    return bound(level, lambda h: F.transform(wave, lambda x: ((x <= h) if low else (x >= h)).cast("int")))


def width_at_half_trough(wave: Column) -> Column:
    """Samples from where the wave falls under half its least value to where it rises again; null unless it does so once."""
    return bound(wave, lambda w: _between(_flags(w, F.array_min(w) / 2, low=True)))


def width_at_half_peak(wave: Column) -> Column:
    """Samples for which the peak after the trough is over half its height; null unless the wave is once."""
    high = lambda w, m: _between(_flags(w, F.array_max(F.slice(w, m + 1, F.size(w))) / 2), m)
    return bound(wave, lambda w: bound(_at(w), lambda m: high(w, m)))


def _before(wave: Column) -> Column:
    """From the trough back to the first sample."""
    return F.reverse(F.slice(wave, F.lit(1), _at(wave) + 1))


def peak_to_trough(wave: Column) -> Column:
    """Samples from the largest value before the trough to it."""
    return bound(bound(wave, _before), lambda b: F.array_position(b, F.array_max(b)).cast("int") - 1)


def pre_peak_half_width(wave: Column) -> Column:
    """Samples for which the peak before the trough, seen from it, is over half its height; null if the wave begins so."""
    return bound(bound(wave, _before), lambda b: _between(_flags(b, F.array_max(b) / 2), once=False))


def is_thin(wave: Column, at: int, threshold: float) -> Column:
    """Whether a standardised wave, its trough in the middle, is above `threshold` at a sample after it."""
    mean = lambda w: F.aggregate(w, F.lit(0.0), lambda s, x: s + x) / F.size(w)
    spread = lambda w, m: F.sqrt(F.aggregate(w, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(w))
    there = lambda w: F.get(w, _at(w) + at - F.floor(F.size(w) / 2).cast("int"))
    return bound(wave, lambda w: bound(mean(w), lambda m: (there(w) - m) / spread(w, m) > threshold))


def rewrapped(phases: Column) -> Column:
    """Angles brought to -pi up to pi."""
    return F.transform(phases, lambda x: F.pmod(x + math.pi, F.lit(2 * math.pi)) - math.pi)


def phase_steps(phases: Column) -> Column:
    """Wrapped steps between neighbouring phases."""
    return bound(phases, lambda p: rewrapped(F.zip_with(F.slice(p, F.lit(2), F.size(p) - 1), F.slice(p, F.lit(1), F.size(p) - 1), lambda b, a: b - a)))


def centred_steps(steps: Column) -> Column:
    """Steps between samples as steps at them: means of the two beside a sample, the one there is at the ends."""
    at = lambda s, i: F.when(i == 0, F.get(s, i)).when(i == F.size(s), F.get(s, i - 1)).otherwise((F.get(s, i) + F.get(s, i - 1)) / 2)
    return bound(steps, lambda s: F.transform(F.sequence(F.lit(0), F.size(s)), lambda i: at(s, i)))


def rotated(re: Column, im: Column, frequency: float, rate: float = 1000.0) -> tuple[Column, Column]:
    """A complex sample one step further at a frequency."""
    c, s = math.cos(2 * math.pi * frequency / rate), math.sin(2 * math.pi * frequency / rate)
    return re * c - im * s, re * s + im * c
