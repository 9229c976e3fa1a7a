"""A Spark-first engine for auditing crawled websites."""
