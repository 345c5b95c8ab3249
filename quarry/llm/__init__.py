"""Operators for preparing training data: archives, filters, deduplication,
decontamination, nearest neighbours and packing.

Nothing else in the library imports this subpackage.
"""
