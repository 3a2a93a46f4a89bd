"""Operators for preparing training data at scale, and their queries.

Nothing else in the package imports this folder.
"""
