"""Program text to syntax tree."""

from .macros import expand_program
from .parser import parse

__all__ = ["expand_program", "parse"]
