"""Operators for training corpora, with their queries. Nothing else in the package imports this."""
