"""Tessera: a Spark-native analytics engine (DataFrame / SQL first)."""

__version__ = "0.1.0"
