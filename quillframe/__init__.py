"""Document collections as queryable Spark tables."""
