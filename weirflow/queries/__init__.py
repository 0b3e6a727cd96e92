"""Registered queries over the driver's tables, by subject."""

from . import bins, chance, dependence, fits, maps, models, more, plane, polars, populations, runs, sampled, shapes, spectra, stores, streams, units, values, waves
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
