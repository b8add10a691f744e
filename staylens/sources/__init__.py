"""Schemas, readers, stand-in table builders and sinks."""
