"""Errors of the search engine."""


class Error(Exception):
    """Any error of the engine."""


class UnsupportedError(Error, NotImplementedError):
    """An option that is known but not offered."""


class InvalidQueryError(Error, ValueError):
    """A query that makes no sense for the model."""


class MissingFieldError(Error, KeyError):
    """A field that the model doesn't have."""
