"""Document analytics as Spark DataFrame plans."""

from .database import Collection, Database, to_documents
from .errors import CatalogError, CompileError, Conflict, DuplicateKey, PapyraError, SyntaxProblem
from .pipeline import Pipeline, Where
from .session import get_session

__all__ = ["CatalogError", "Collection", "CompileError", "Conflict", "Database", "DuplicateKey", "PapyraError", "Pipeline", "SyntaxProblem", "Where", "get_session", "to_documents"]
