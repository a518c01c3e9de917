"""qissaflow: Spark-native analytics over large collections of narrative text."""

__version__ = "0.1.0"
