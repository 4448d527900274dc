"""What can go wrong before a plan runs."""


class PapyraError(Exception):
    """Base of all errors of this package."""


class SyntaxProblem(PapyraError):
    """The text is not a statement; position is the offset at which it stops making sense."""

    def __init__(self, message: str, position: int = -1):
        super().__init__(f"{message} (at {position})" if position >= 0 else message)
        self.position = position


class CompileError(PapyraError):
    """The statement has no meaning for this collection."""


class CatalogError(PapyraError):
    """A database, collection or index is missing, exists already, or has a bad name."""


class DuplicateKey(PapyraError):
    """A write would break a unique index or repeat an _id."""


class Conflict(PapyraError):
    """Another session committed first."""
