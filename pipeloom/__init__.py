"""Route analytics on Spark: relational, geometric and sequence operators over pipe-route tables."""
