"""Operators for preparing language-model training data, each with its query.

Nothing else in the library imports this subpackage.
"""
