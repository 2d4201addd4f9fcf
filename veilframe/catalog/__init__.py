"""All registered queries with their checking SQL."""

from veilframe.catalog import analytics, data, masking, privacy
from veilframe.catalog.base import REGISTRY, Entry

__all__ = ["REGISTRY", "Entry", "analytics", "data", "masking", "privacy"]
