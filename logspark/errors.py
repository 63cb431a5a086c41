"""Errors that carry the place in the program they are about."""

from __future__ import annotations


class ProgramError(ValueError):
    """A message and the span (start, end) of program text it concerns."""

    def __init__(self, message: str, span: tuple[int, int] | None = None):
        super().__init__(message)
        self.message, self.span = message, span

    def shown(self, text: str, around: int = 2) -> str:
        """The message with the lines around its span."""
        if self.span is None:
            return self.message
        start, end = self.span
        first, last = text.count("\n", 0, start), text.count("\n", 0, max(start, end - 1))
        lines = text.split("\n")
        out = [f"{first + 1}:{start - (text.rfind(chr(10), 0, start) + 1) + 1}: {self.message}"]
        for n in range(max(0, first - around), min(len(lines), last + around + 1)):
            out.append(f"{'>' if first <= n <= last else ' '} {n + 1:4} | {lines[n]}")
        return "\n".join(out)


class ParseError(ProgramError):
    pass


class BindError(ProgramError):
    pass


class SourceError(RuntimeError):
    """A source that can't be read as asked."""
