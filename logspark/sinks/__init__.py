"""Printed results."""

from .formats import FORMATS, write

__all__ = ["FORMATS", "write"]
