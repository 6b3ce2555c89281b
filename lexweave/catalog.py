"""All registered queries of the engine and, where DuckDB can express them, their SQL."""

from .plans import candidates, catalogue, decisions, evidence, facets, graph, inventory, labels, linkage, maintenance, neighbors, notes, quality, retrieval
from .plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "candidates", "catalogue", "decisions", "evidence", "facets", "graph", "inventory", "labels", "linkage", "maintenance", "neighbors", "notes", "quality", "retrieval"]
