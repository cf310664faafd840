"""Retrieve, score, rank and evaluate nested records with Spark DataFrames."""

from plumbline.config import DEFAULTS, Settings

__all__ = ["DEFAULTS", "Settings"]
