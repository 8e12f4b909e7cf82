"""Data-quality analytics on PySpark: checks, profiles, run history, triage and lineage as DataFrame operators."""

__version__ = "0.1.0"
