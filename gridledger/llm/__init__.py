"""Operators for training-data pipelines: filters, near duplicates, masking, token counts, mixing.

Nothing else in the library imports this package.
"""
