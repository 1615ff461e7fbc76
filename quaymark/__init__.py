"""quaymark: a Spark-native engine over event logs and entity snapshots."""

__version__ = "0.1.0"
