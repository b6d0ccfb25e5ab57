"""Document-archive analytics as Spark jobs."""
