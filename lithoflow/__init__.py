"""Document-to-canonical analytics on Spark."""
