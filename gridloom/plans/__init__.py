"""All registered queries of the library's own operators."""

from gridloom.plans import extras, files, matching, pixels, structure  # noqa: F401
from gridloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
