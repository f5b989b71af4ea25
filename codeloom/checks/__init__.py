"""Registered queries and their oracles over the driver tables."""

from codeloom.checks import derived, findings, graphs, lines, nodes  # noqa: F401
from codeloom.checks.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
