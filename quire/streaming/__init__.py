"""Structured Streaming form of the grader."""
