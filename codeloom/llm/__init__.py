"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it; its queries and their SQL twins are
in :mod:`codeloom.llm.queries`.
"""
