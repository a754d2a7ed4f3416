"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Every module holds one operator
with a general interface; `queries.py` derives the digest columns of the
registered queries from the operators' real outputs.
"""
