"""Registered queries and their DuckDB equivalents, grouped by subject."""

from pagelens.catalog import (
    evidence,
    extraction,
    graph,
    mail,
    measures,
    outputs,
    runs,
    seeds,
    streams,
)
from pagelens.catalog.base import ORACLES, QUERIES

__all__ = [
    "ORACLES",
    "QUERIES",
    "evidence",
    "extraction",
    "graph",
    "mail",
    "measures",
    "outputs",
    "runs",
    "seeds",
    "streams",
]
