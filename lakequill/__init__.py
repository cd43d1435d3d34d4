"""Corpus preparation, batch retrieval and retrieval evaluation as Spark DataFrame jobs."""
