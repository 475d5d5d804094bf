"""Readers for the input tables, the analysis views built on them, and table sinks."""
