"""Document-field extraction and quality analytics as Spark jobs."""
