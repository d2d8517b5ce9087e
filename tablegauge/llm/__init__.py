"""Operators for preparing language-model training data, and the queries that apply them.

Nothing outside this package imports it; it may import general helpers of the library.
"""
