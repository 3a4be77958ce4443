"""Graphs from text files and from tables; sinks."""
