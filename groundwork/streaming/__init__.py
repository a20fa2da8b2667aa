"""Streams of questions."""
