"""Operators of a training-data pipeline: deduplication, classifiers, tokens, mixing."""
