"""Operators of a training-data pipeline: dedup, scoring, search, formatting, mixing."""
