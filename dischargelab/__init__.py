"""Spark-native sorting and analysis of motor-unit discharges in sampled traces."""

__version__ = "0.1.0"
