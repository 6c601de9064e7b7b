"""Named queries over the given tables and the SQL that checks them."""

from riskloom.registry import declared, features, host, labelling, models, quality, scoring, sources, streams
from riskloom.registry.core import CHECKS, QUERIES

__all__ = [
    "CHECKS", "QUERIES", "declared", "features", "host", "labelling", "models", "quality",
    "scoring", "sources", "streams",
]
