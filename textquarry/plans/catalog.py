"""All registered queries."""

from textquarry.plans import experiments, preparation, responses, scans, streams  # noqa: F401
from textquarry.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
