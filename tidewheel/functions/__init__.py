"""Scalar functions as column expressions."""

from .text import event_time, float_text, number, payload, upper_value, window_text

__all__ = ["event_time", "float_text", "number", "payload", "upper_value", "window_text"]
