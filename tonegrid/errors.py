"""Exceptions of the engine; the command line prints them and exits with 1."""


class EngineError(Exception):
    """Base of all errors a user can cause."""


class InputError(EngineError):
    """An input file is missing or of an unknown kind."""


class ModelError(EngineError):
    """A model is unknown or its provider is not available."""
