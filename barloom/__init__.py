"""barloom: a Spark-native engine for market-bar data and data preparation at scale."""

__version__ = "0.1.0"
