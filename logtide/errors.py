"""Exceptions of the engine."""


class TelemetryError(Exception):
    """Base of all errors raised here."""


class ConfigError(TelemetryError):
    """A setting is missing or out of range."""


class ParseError(TelemetryError):
    """An input record cannot be read at all."""


class StorageError(TelemetryError):
    """A table cannot be written or read."""


class StreamError(TelemetryError):
    """A stream cannot be started or decoded."""
