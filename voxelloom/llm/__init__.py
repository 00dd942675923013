"""Operators for preparing training text: de-duplication, filters, classifiers, formats and tokens."""
