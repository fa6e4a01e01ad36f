"""tidemark: market-signal analytics as Spark DataFrame jobs."""
