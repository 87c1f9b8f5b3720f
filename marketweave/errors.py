"""Errors of sources, sinks and pipelines."""


class DataSourceError(Exception):
    """Any failure of a source, a sink or a pipeline step."""


class TransientError(DataSourceError):
    """May succeed when tried again: timeouts, dropped sockets, server errors."""


class PermanentError(DataSourceError):
    """Will fail again: bad settings, refused access, wrong shape."""


class SchemaMismatchError(PermanentError):
    """A frame lacks columns that its record schema declares."""
