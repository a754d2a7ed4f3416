"""Readers and writers: JSON lines, documents, contracts, reports, baselines and repositories."""
