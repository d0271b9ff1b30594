"""Windows, aggregates, clocks and keyed processing."""

from .aggregates import Aggregate, count, custom, total
from .clock import InputClocks, OutOfOrderClock, with_clock
from .windows import Session, Sliding, Tumbling

__all__ = ["Aggregate", "InputClocks", "OutOfOrderClock", "Session", "Sliding", "Tumbling", "count", "custom", "total", "with_clock"]
