"""Errors by the stage that raises them; their text begins with the kind."""

from __future__ import annotations


class EngineError(Exception):
    kind = "internal error"

    def __str__(self) -> str:
        return f"{self.kind}: {super().__str__()}"


class ParseError(EngineError):
    kind = "parse error"


class PlanError(EngineError):
    kind = "plan error"


class TypeMismatch(EngineError):
    kind = "type error"


class ExecutionError(EngineError):
    kind = "execution error"


class StorageError(EngineError):
    kind = "storage error"
