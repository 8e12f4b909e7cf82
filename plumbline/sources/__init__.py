"""Readers, the SQL workbench and sinks."""
