"""sablefish: Spark-native code and data-dictionary analytics."""

__version__ = "0.1.0"
