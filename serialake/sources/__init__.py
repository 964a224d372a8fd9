"""A: sources and sinks."""
