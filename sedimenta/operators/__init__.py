"""Relational, retrieval, state and chunking operators."""
