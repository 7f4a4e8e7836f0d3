"""Registered query plans over the driver's tables."""

from evidrel.plans import curation, evidence, labelling, language, learned, market, planned, resolution, scans, search
from evidrel.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "curation", "evidence", "labelling", "language", "learned", "market", "planned", "resolution", "scans", "search"]
