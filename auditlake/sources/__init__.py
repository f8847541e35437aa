"""Readers that turn report text into rows."""
