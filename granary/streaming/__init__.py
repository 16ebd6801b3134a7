"""Metrics of unbounded inputs, by merging partial results of micro-batches."""
