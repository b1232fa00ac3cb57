"""Transaction-ledger analytics as Spark DataFrame and Structured Streaming jobs."""
