"""Contact-centre conversation analytics as Spark DataFrame and streaming jobs."""
