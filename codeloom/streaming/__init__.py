"""Streaming forms of the operators (beyond the batch engine)."""
