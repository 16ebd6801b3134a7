"""Readers: files, databases, object stores, and a registry of source types."""
