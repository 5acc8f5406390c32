"""What can go wrong, by whose fault it is: the statement, the names and shapes it uses, the values it meets, or the limits.

Each error says in its own words what was found and what would have been right. Texts that executors raise carry a tag, by
which typed() finds the error again on the driver.
"""

from __future__ import annotations

import re


class EngineError(Exception):
    """Any refusal by the engine; the text is meant for the user."""


# The statement.
class SqlError(EngineError):
    """A text that is no statement of the dialect; position is a byte of it."""

    def __init__(self, position: int, message: str):
        self.position, self.message = position, message
        super().__init__(f"{message} (at byte {position} of the statement)")


class InvalidQuery(EngineError):
    """A well-formed statement that asks for something the dialect does not have."""


class InsertOnlyStatementRequired(EngineError):
    def __init__(self, statement: str):
        super().__init__(f"a batch of inserts may hold nothing but INSERT, and here is {statement}")


# Names.
class TableNotFound(EngineError):
    def __init__(self, table: str):
        super().__init__(f"no table is called '{table}'")


class TableAlreadyExists(EngineError):
    def __init__(self, table: str):
        super().__init__(f"the name '{table}' belongs to another table")


class ColumnNotFound(EngineError):
    def __init__(self, table: str, column: str):
        super().__init__(f"table '{table}' has no column '{column}'")


class DuplicateColumn(EngineError):
    def __init__(self, column: str):
        super().__init__(f"'{column}' is named more than once")


class ReservedIdentifier(EngineError):
    def __init__(self, identifier: str, context: str):
        super().__init__(f'{context} cannot be "{identifier}", which is a Boolean literal')


# Shapes and types.
class RowLength(EngineError):
    def __init__(self, table: str, expected: int, actual: int):
        super().__init__(f"table '{table}' takes rows of {expected} values, this one has {actual}")


class UnionColumnCountMismatch(EngineError):
    def __init__(self, kind: str, left: int, right: int):
        super().__init__(f"both sides of UNION {kind} need as many columns: {left} on the left, {right} on the right")


class TypeMismatch(EngineError):
    def __init__(self, context: str, expected, actual):
        self.context = context
        super().__init__(f"{context} takes {expected}, not {actual}")


# Values.
class InvalidCast(EngineError):
    def __init__(self, source, target):
        super().__init__(f"a {source} value does not read as {target}")


class NumericOverflow(EngineError):
    def __init__(self, operation: str):
        self.operation = operation
        super().__init__(f"the result of {operation} has no place in its type")


class ImportFailed(EngineError):
    """A malformed CSV, TSV or JSON line; nothing of the input was taken."""


# Limits.
class ResourceLimitExceeded(EngineError):
    def __init__(self, resource: str, actual: int, most: int):
        self.resource = resource
        super().__init__(f"{resource}: {actual} or more are needed, {most} are allowed")


class StatementLimitExceeded(EngineError):
    def __init__(self, statements: int, most: int):
        super().__init__(f"a script may hold {most} statements, this one holds {statements} or more")


class DatabaseBusy(EngineError):
    def __init__(self):
        super().__init__("another statement holds the tables; ask again")


TAG = "stratalith:"
_FOUND = re.compile(TAG + r"(overflow|cast):([^:\n]*):?([^:\n]*):")


def overflow_text(operation: str) -> str:
    return f"{TAG}overflow:{operation}::"


def cast_text(source, target) -> str:
    return f"{TAG}cast:{source}:{target}:"


def typed(error: Exception) -> Exception:
    """The typed error that an executor raised, or the error itself."""
    if isinstance(error, EngineError):
        return error
    if found := _FOUND.search(str(error)):
        return NumericOverflow(found[2]) if found[1] == "overflow" else InvalidCast(found[2], found[3])
    return error
