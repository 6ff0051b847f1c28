"""Training-data operators: formatting, tokenisation, dedup, filters, mixing.

Nothing else in the package imports this subpackage; it can be deleted whole.
"""
