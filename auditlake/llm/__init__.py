"""Operators for preparing large text and vector corpora."""
