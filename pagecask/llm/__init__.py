"""Operators that prepare archive texts as training data.

Nothing outside this subpackage imports it.
"""
