"""Schemas, table loading, fixture views, readers and sinks."""
