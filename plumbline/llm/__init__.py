"""Operators of a training-data pipeline: formatting, tokens, filters, duplicates, packing."""
