"""Operators for preparing large training corpora (texts, vectors, benchmarks).

Nothing else in the library imports this subpackage.
"""
