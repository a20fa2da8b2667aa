"""Whole plans: an index, batches of questions, evaluations, reports."""
