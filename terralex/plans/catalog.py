"""All named queries and their SQL."""

from terralex.plans import places, scoring, tables
from terralex.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "places", "scoring", "tables"]
