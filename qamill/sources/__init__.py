"""Readers, payload normalisation, sinks, incremental runs and the cache."""
