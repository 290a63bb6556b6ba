"""Profiling, cleaning and curation of tables as Spark plans."""
