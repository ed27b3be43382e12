"""News-event analytics as Spark jobs."""
