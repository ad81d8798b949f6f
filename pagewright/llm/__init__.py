"""Training-data operators: filters, dedup, mixing, search, tokenising.

Self-contained: nothing else in the library imports this subpackage.
"""
