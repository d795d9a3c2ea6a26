"""All queries of the library, with their SQL where there is any."""

from . import cluster_queries, io_queries, pair_queries, relational_queries, sketch_queries, tree_queries, window_queries  # noqa: F401
from .base import ORACLE_SQL, QUERIES  # noqa: F401
