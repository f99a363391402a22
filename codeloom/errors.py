"""Errors raised while a job is being put together."""


class InvalidInput(ValueError):
    """An argument or an input table does not meet its contract."""


class IndexProblem(RuntimeError):
    """A stored index is missing, incomplete or was built by another vectoriser."""


class VectorProblem(RuntimeError):
    """A vectoriser returned something other than one vector per text."""


class HookFailed(RuntimeError):
    """A user hook raised, or returned a table that breaks the contract."""
