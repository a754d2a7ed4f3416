"""A data-contract engine on PySpark: profile, validate, compare, trace and report datasets."""
