"""Operators of a training-data pipeline; nothing else in this package imports them."""
