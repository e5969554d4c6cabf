"""Operators for preparing training text: tokens, duplicates, filters, archives, vectors.

Nothing else in the library imports this subpackage.
"""
