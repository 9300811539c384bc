"""Structured Streaming jobs of the batch path."""
