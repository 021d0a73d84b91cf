"""Errors of the library; all derive from TableError."""


class TableError(Exception):
    pass


class ConfigError(TableError):
    """A missing, malformed or contradictory table or read option."""


class SchemaError(TableError):
    """No schema can be resolved, or a column isn't in it."""


class TimelineError(TableError):
    """A timestamp or timeline file that can't be understood."""


class UnsupportedError(TableError):
    """A feature that this library doesn't have."""


class CorruptFileError(TableError):
    """A data or log file that breaks its format."""
