"""Queries over the driver tables, each with the SQL that must agree."""

from storyweave.workload import bundle, landing, relations, scalars  # noqa: F401
from storyweave.workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
