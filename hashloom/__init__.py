"""Feature store for content-addressed entities, built on Spark DataFrames.

Entities are rows keyed by a digest (``hash``).  A database holds one entity table with
single-valued features as columns and any number of multi-valued features as
``(hash, value)`` frames.  Several databases form a namespace with precedence, and
entity domains (contexts) are linked by translator features.
"""

import sys

from pyspark import cloudpickle

from hashloom.plans.filters import feature, number, term
from hashloom.plans.namespace import Database, Feature, Namespace, Values
from hashloom.plans.query import entity_hashes, select

__all__ = [
    "Database",
    "Feature",
    "Namespace",
    "Values",
    "entity_hashes",
    "feature",
    "number",
    "select",
    "term",
]

# functions of this package that run in Python workers travel with the job
cloudpickle.register_pickle_by_value(sys.modules[__name__])
