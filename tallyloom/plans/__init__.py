"""Declared schemas and committed reference dimensions."""
