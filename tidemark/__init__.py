"""tidemark: a Spark-native engine for daily equity series and decision audit data."""

__version__ = "0.1.0"
