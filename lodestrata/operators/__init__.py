"""Operators on panels, events and reference tables."""
