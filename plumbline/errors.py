"""Exceptions raised by the library."""


class PlumblineError(Exception):
    """Base class of every error raised here."""


class LoadError(PlumblineError):
    """A source could be found but not read."""


class SourceNotFound(LoadError):
    """The path or table of a source does not exist."""

    def __init__(self, uri: str):
        super().__init__(f"source not found: {uri}")
        self.uri = uri


class UnsupportedFormat(LoadError):
    """No reader is known for the extension or kind of a source."""

    def __init__(self, kind: str):
        super().__init__(f"unsupported file format: {kind}")
        self.kind = kind


class QueryError(PlumblineError):
    """SQL text failed to parse, resolve or run."""


class MissingColumns(PlumblineError, ValueError):
    """An operator was given names that the frame does not have."""


class InsufficientData(PlumblineError):
    """Fewer usable rows than an operator needs."""

    def __init__(self, required: int, actual: int):
        super().__init__(f"need at least {required} rows, got {actual}")
        self.required = required
        self.actual = actual


class DetectionError(PlumblineError):
    """Anomaly detection cannot run as configured."""


class DuplicateKeys(PlumblineError):
    """Columns given as a row key are not unique."""
