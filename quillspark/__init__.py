"""Retrieval, evaluation and corpus preparation as Spark DataFrame plans."""
