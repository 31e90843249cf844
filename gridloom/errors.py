"""What can go wrong."""


class GridloomError(Exception):
    """Base of all errors of this library."""


class TransactionError(GridloomError):
    """A commit lost against another one it cannot be combined with."""


class IngestionError(GridloomError):
    """A source could not be taken in."""


class QueryError(GridloomError):
    """A query asks for something that is not there."""


class ValidationError(GridloomError):
    """Data breaks the schema or a rule of the store."""
