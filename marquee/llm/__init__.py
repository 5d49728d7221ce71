"""Operators for preparing training text: scoring, duplicates, contamination, quality, filters, secrets and packing.

Nothing else in the library imports this subpackage.
"""
