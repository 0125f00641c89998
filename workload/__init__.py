"""Queries of the library over the driver tables."""

from workload import fusion, labelling, logs, storage, streams  # noqa: F401
from workload.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
