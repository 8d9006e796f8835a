"""tidewell: a Spark-native engine for consumer-text and catalogue analytics."""

__version__ = "0.1.0"
