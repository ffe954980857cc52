"""lexigrain: Spark-native analytics of short and long texts."""

__version__ = "0.1.0"
