"""driftgrove: Spark-native incremental hierarchical clustering of tokenised text."""

__version__ = "0.1.0"
