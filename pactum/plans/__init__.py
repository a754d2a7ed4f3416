"""Clauses, their compilation to DataFrame aggregates, and contract synthesis."""
