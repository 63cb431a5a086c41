"""logspark: a Spark-native analytics engine for line-oriented logs."""

from .engine import Engine, Result
from .errors import BindError, ParseError, ProgramError, SourceError

__all__ = ["BindError", "Engine", "ParseError", "ProgramError", "Result", "SourceError"]
__version__ = "0.1.0"
