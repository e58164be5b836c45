"""Spark-native analytics over metered time series."""

__version__ = "0.1.0"
