"""Training-data operators: ten components and the queries that apply them.

Nothing outside this subpackage imports it.
"""
