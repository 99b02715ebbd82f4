"""Operators of a training-data pipeline; nothing outside this package uses it."""
