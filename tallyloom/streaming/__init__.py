"""Structured Streaming twins of slice ingestion and event windows."""
