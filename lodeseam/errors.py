"""Errors that callers can tell apart."""


class LodeseamError(Exception):
    """Base of all errors of this package."""


class ValidationError(LodeseamError):
    """A task, target, measure or argument that cannot be right."""


class CsvError(LodeseamError):
    """Text that is not well-formed CSV; `line` counts from 1."""

    def __init__(self, message: str, line: int | None = None) -> None:
        super().__init__(message if line is None else f"line {line}: {message}")
        self.line = line


class SearchSpaceError(LodeseamError):
    """A search space that is empty or does not fit the table."""


class BackendError(LodeseamError):
    """An execution strategy that was asked for and cannot run the task."""


class AbortedError(LodeseamError):
    """The caller stopped the search."""


class DialectError(LodeseamError):
    """Text that is no printed selector or conjunction."""
