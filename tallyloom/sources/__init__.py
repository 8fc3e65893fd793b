"""Snapshot readers and sinks."""
