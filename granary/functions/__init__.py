"""Scalar helpers, as columns and, for names and configuration, as plain Python."""
