"""Understand unfamiliar tables and test what people believe about them, as Spark jobs."""
