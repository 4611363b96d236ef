"""Imports every query module so that the registry is complete."""

from starlens.plans import analysis, boundaries, embeddings, files, forest, io, markup, ml, numeric, phrases, products, texts  # noqa: F401
from starlens.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
