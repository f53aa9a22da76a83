"""Paper-graph analytics on Spark: DataFrame-to-DataFrame operators keyed by node id."""

__version__ = "0.1.0"
