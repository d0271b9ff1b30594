"""Jobs over unbounded input."""

from .checkpoint import Savepoints, SavepointError, batches
from .exact import exact_windows
from .native import native_windows
from .process import KeyedState, keyed_process
from .supervisor import Supervisor

__all__ = ["KeyedState", "SavepointError", "Savepoints", "Supervisor", "batches", "exact_windows", "keyed_process", "native_windows"]
