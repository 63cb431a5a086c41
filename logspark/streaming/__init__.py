"""Unbounded input: the stateless part of the language over Structured Streaming."""

from .follow import follow

__all__ = ["follow"]
