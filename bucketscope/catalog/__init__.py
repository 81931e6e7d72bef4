"""All registered queries."""

from bucketscope.catalog import audits, directories, filters, orders, rendering, scans
from bucketscope.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "audits", "directories", "filters", "orders", "rendering", "scans"]
