"""Errors of the federation engine."""


class FederationError(Exception):
    """A federated table can't be built or queried."""


class UnsupportedOperation(FederationError):
    """Something that plain columns can't do."""
