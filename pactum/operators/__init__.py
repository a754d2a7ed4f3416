"""Validation, profiling, drift, evolution, lineage, AI checks, reports and canonical-record transforms."""
