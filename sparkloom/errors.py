"""Errors of the engine."""


class EngineError(Exception):
    """Any error of the engine; ``context`` says what was being done."""

    def __init__(self, message: str, context: str | None = None):
        super().__init__(f"{context}: {message}" if context else message)
        self.context = context


class PlanError(EngineError):
    """A query that can't be planned."""


class NotImplementedInEngine(PlanError):
    """A construct that the front end rejects."""


class SchemaError(EngineError):
    """An unknown or ambiguous column."""


class IoError(EngineError):
    """A source that can't be read."""
