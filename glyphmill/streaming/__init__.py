"""Streams of resource lines: the stateless rules run unchanged; duplicate keys keep state."""

from glyphmill.streaming.resources import stream_differences, stream_duplicates, stream_entries

__all__ = ["stream_differences", "stream_duplicates", "stream_entries"]
