"""The registered queries: one per operator, over the driver's tables, with the SQL each equals."""

from hashloom.suite import catalogue, filters, jobs, resolving, scalars, sources, writing
from hashloom.suite.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "catalogue", "filters", "jobs", "resolving", "scalars", "sources", "writing"]
