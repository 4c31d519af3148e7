"""Errors by kind; each can carry a context."""

from __future__ import annotations


class EngineError(Exception):
    kind = "unknown"

    def __init__(self, message: str = "", cause: Exception | None = None):
        super().__init__(message)
        self.cause, self.context = cause, {}

    def with_context(self, key: str, value: object) -> EngineError:
        self.context[key] = value
        return self


class ValidationFailed(EngineError):
    kind = "validation"


class NotFound(EngineError):
    kind = "not_found"


class AlreadyExists(EngineError):
    kind = "already_exists"


class Closed(EngineError):
    kind = "closed"


class IoFailed(EngineError):
    kind = "io"


class EncryptionFailed(EngineError):
    kind = "encryption"


class IndexFailed(EngineError):
    kind = "index"


class QueryFailed(EngineError):
    kind = "query"


class SchemaFailed(EngineError):
    kind = "schema"


class Conflict(EngineError):
    kind = "conflict"


def is_kind(error: BaseException, kind: str) -> bool:
    return isinstance(error, EngineError) and error.kind == kind
