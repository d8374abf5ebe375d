"""Readers for the supplied tables, fixture mappings, raw sources and sinks."""
