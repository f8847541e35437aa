"""Relational kernels: joins, aggregates, windows, sets."""
