"""Errors raised by guards and contract checks."""


class ContractError(ValueError):
    """A table does not satisfy a rule the caller asked to enforce."""
