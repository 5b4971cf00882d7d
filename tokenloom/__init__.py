"""Token analytics on Spark: count, classify, rank and report how text spends a model's context."""
