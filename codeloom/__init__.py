"""Code-quality analytics as Spark DataFrame jobs."""
