"""Incremental variants on Structured Streaming; each has a batch twin."""

from .streams import current_gaps, latest, read_files, stream_append, stream_gaps, stream_moments, stream_verify

__all__ = ["current_gaps", "latest", "read_files", "stream_append", "stream_gaps", "stream_moments", "stream_verify"]
