"""Retrieval-augmented question answering and its evaluation as Spark plans."""
