"""Operators for building training corpora at large scale. Nothing else in the library imports this package."""
