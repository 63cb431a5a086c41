"""Syntax tree to bound tree: names, types and levels resolved."""

from .binder import Binder, bind_program

__all__ = ["Binder", "bind_program"]
