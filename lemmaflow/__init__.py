"""Analytics over proof-search logs as Spark DataFrame jobs."""
