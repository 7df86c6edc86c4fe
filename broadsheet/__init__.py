"""Media-corpus analytics as Spark DataFrame jobs."""
