"""All named queries."""

from importlib import import_module

from plumbline.catalog.base import REGISTRY, Query

_SECTIONS = ("scalars", "texts", "vectors", "joins", "windows", "aggregates", "integrity", "scoring", "quality", "samples", "cleaning",
             "explanations", "enrichment", "artifacts", "outputs")
for _section in _SECTIONS:
    import_module(f"plumbline.catalog.{_section}")

__all__ = ["REGISTRY", "Query"]
