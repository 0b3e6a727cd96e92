"""weirflow: time-series, event, array and statistical analytics as PySpark DataFrame operations."""
