"""Sources and sinks."""

from .generator import GeneratedSource, generator, generator_stream, late_script
from .httplog import ClockedLogSource, HttpLogSource, write_log
from .scripted import ScriptedSource, scripted, write_script
from .sinks import console_sink, idempotent, split_late, stdout_lines

__all__ = ["ClockedLogSource", "GeneratedSource", "HttpLogSource", "ScriptedSource", "console_sink", "generator", "generator_stream", "idempotent", "late_script", "scripted", "split_late", "stdout_lines", "write_log", "write_script"]
