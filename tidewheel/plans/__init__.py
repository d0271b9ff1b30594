"""Plans of a job over bounded rows."""

from .bounded import late_rows, window_results, windowed
from .process import dedup, list_state, running_count

__all__ = ["dedup", "late_rows", "list_state", "running_count", "window_results", "windowed"]
