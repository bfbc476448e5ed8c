"""Operators for preparing training data: filtering, deduplication, formatting, packing, output.

Nothing else in the library imports this subpackage; it takes only general helpers from it.
"""
