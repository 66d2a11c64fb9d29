"""Operators for large text corpora: ten self-contained modules over ``documents``-like tables.

Nothing outside this subpackage imports it; deleting the folder leaves the rest of the library whole.
"""
