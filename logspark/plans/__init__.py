"""Bound relations to DataFrames."""

from .lower import Lowering, Options

__all__ = ["Lowering", "Options"]
