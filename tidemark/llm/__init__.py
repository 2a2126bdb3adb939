"""Operators for large text collections: one module each, with their queries in ``registry``."""
