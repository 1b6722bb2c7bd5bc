"""Operators that prepare text corpora for language-model training.

Nothing else in the package imports this subpackage; it can be removed whole.
"""
