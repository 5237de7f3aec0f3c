"""Typed errors; each carries the code that front ends report."""


class DialectError(Exception):
    code = "EXECUTION_ERROR"


class ParseError(DialectError):
    code = "SQL_PARSE_ERROR"


class UnsupportedSyntax(ParseError):
    code = "UNSUPPORTED_SYNTAX"


class UnknownTable(DialectError):
    code = "UNKNOWN_TABLE"


class UnknownColumn(DialectError):
    code = "UNKNOWN_COLUMN"


class AmbiguousColumn(DialectError):
    code = "AMBIGUOUS_COLUMN"


class TypeMismatch(DialectError):
    code = "TYPE_MISMATCH"


class UniqueViolation(DialectError):
    code = "UNIQUE_VIOLATION"


class NotNullViolation(DialectError):
    code = "NOT_NULL_VIOLATION"


class ForeignKeyViolation(DialectError):
    code = "FOREIGN_KEY_VIOLATION"


class InvalidDefault(DialectError):
    code = "INVALID_DEFAULT"


class DuplicateIndex(DialectError):
    code = "DUPLICATE_INDEX"


class SchemaError(DialectError):
    code = "SCHEMA_ERROR"


class TransactionError(DialectError):
    code = "TRANSACTION_ERROR"


class Conflict(DialectError):
    code = "CONFLICT"


class StorageError(DialectError):
    code = "STORAGE_ERROR"
