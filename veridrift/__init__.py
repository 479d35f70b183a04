"""veridrift: Spark-native evaluation of selection experiments and audit of their data."""

__version__ = "0.1.0"
