"""Importing this module registers every query."""

from . import cleaning, dashboards, evaluation, explaining, modelling, records, scoring, segmenting, stores, streams  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
