"""Operators for preparing large text corpora for language-model training.

Each module holds one operator with its own general interface; ``queries.py``
binds the thin ``opN_<name>`` queries.  Nothing outside this package imports
it.
"""
