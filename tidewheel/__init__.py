"""Keyed event-time stream analytics on Spark."""

from .job import Job
from .operators import Session, Sliding, Tumbling, count, custom, total

__all__ = ["Job", "Session", "Sliding", "Tumbling", "count", "custom", "total"]
