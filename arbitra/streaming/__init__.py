"""Structured Streaming forms of deciding, monitoring and logging."""
from arbitra.streaming.decisions import ask_stream, log_stream, monitor

__all__ = ["ask_stream", "log_stream", "monitor"]
