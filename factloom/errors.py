"""Errors with a code, a message and details, as results of queries give them."""

from __future__ import annotations

import json


class QueryError(Exception):
    """Base of all errors; ``code`` names the kind."""

    code = "Internal"

    def __init__(self, message: str, **details: object) -> None:
        super().__init__(message)
        self.message, self.details = message, details

    def to_json(self) -> str:
        return json.dumps({"code": self.code, "message": self.message, "details": self.details}, default=str)


class InvalidArgument(QueryError):
    code = "InvalidArgument"


class SymbolNotFound(QueryError):
    code = "SymbolNotFound"


class ProjectNotFound(QueryError):
    code = "ProjectNotFound"


class FileNotFound(QueryError):
    code = "FileNotFound"


class AmbiguousMatch(QueryError):
    code = "AmbiguousMatch"


class NotLoaded(QueryError):
    code = "NotLoaded"
