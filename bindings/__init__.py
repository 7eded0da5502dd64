"""Bindings of the library's operators to the driver tables, each with its SQL equivalent."""

from . import counters, dumps, history, intervals, logs, projections, relations, rollups, services, sinks, stored, streams, tables  # noqa: F401
from .common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
