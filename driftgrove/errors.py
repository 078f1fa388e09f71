"""The kinds of errors that the library raises."""


class InvalidConfiguration(ValueError):
    """A parameter is out of range or missing."""


class StateError(RuntimeError):
    """An operation doesn't fit the engine's state."""
