"""Readers, SQL views and sinks."""
