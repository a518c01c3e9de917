"""Operators that prepare text collections for training language models.

Nothing outside this subpackage imports it.
"""
