"""Document, record and event analytics expressed as Spark jobs."""
