"""The dialect's types: their literals, their Spark storage, and how their values are shown."""

from __future__ import annotations

import datetime as dt
import json
import re
import uuid
from dataclasses import dataclass
from decimal import Decimal, InvalidOperation

from pyspark.sql import types as T

from ..errors import ParseError, TypeMismatch

INT_MIN, INT_MAX = -(1 << 63), (1 << 63) - 1
BIGINT_DIGITS = 38  # the widest whole number that Spark stores

NUMERIC = frozenset({"int", "bigint", "decimal"})
#: Types that < > <= >= take, and those that `like` takes.
RANGED = NUMERIC | {"date", "timestamp"}
GLOBBED = frozenset({"text", "varchar"})

_SPARK = {
    "bool": T.BooleanType(),
    "int": T.LongType(),
    "bigint": T.DecimalType(BIGINT_DIGITS, 0),
    "text": T.StringType(),
    "varchar": T.StringType(),
    "date": T.DateType(),
    "timestamp": T.TimestampNTZType(),
    "uuid": T.StringType(),
    "json": T.StringType(),
    "blob": T.BinaryType(),
}


@dataclass(frozen=True)
class DType:
    name: str
    p: int | None = None  # precision, or length of varchar
    s: int | None = None

    def __str__(self) -> str:
        if self.name == "decimal":
            return f"decimal({self.p},{self.s})"
        return f"varchar({self.p})" if self.name == "varchar" else self.name

    @property
    def spark(self) -> T.DataType:
        return T.DecimalType(self.p, self.s) if self.name == "decimal" else _SPARK[self.name]


def parse_type(text: str) -> DType:
    """`int`, `decimal(10,2)`, `varchar(5)`, ..."""
    m = re.fullmatch(r"\s*([A-Za-z]+)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?\s*", text)
    if not m:
        raise ParseError(f"Bad type '{text}'")
    name, p, s = m[1].lower(), m[2], m[3]
    if name == "decimal":
        if p is None or s is None or not 1 <= int(p) <= 38 or int(s) > int(p):
            raise ParseError(f"Bad decimal type '{text}': it needs 1 <= precision <= 38 and scale <= precision")
        return DType("decimal", int(p), int(s))
    if name == "varchar":
        if p is None or s is not None or int(p) == 0:
            raise ParseError(f"Bad varchar type '{text}': it needs a length above 0")
        return DType("varchar", int(p))
    if name not in _SPARK or p is not None:
        raise ParseError(f"Unknown type '{text}'")
    return DType(name)


def canonical_json(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def parse_literal(text: str, dtype: DType):
    """The value of a literal for a column of `dtype`; the word null, quoted or not, is None."""
    if text.lower() == "null":
        return None
    bad = TypeMismatch(f"'{text}' is not a value of type {dtype}")
    try:
        match dtype.name:
            case "bool":
                return {"true": True, "1": True, "false": False, "0": False}[text.lower()]
            case "int":
                if not re.fullmatch(r"[+-]?\d+", text) or not INT_MIN <= int(text) <= INT_MAX:
                    raise bad
                return int(text)
            case "bigint":
                if not re.fullmatch(r"[+-]?\d+", text) or len(text.lstrip("+-").lstrip("0")) > BIGINT_DIGITS:
                    raise bad
                return Decimal(text)
            case "decimal":
                if not re.fullmatch(r"[+-]?(\d+(\.\d*)?|\.\d+)", text):
                    raise bad
                value = Decimal(text)
                shown = format(value, "f").lstrip("+-")
                whole, _, part = shown.partition(".")
                # a leading zero counts as a digit; what Spark's decimal can't hold is refused as well
                if len(part) > dtype.s or len(whole or "0") + len(part) > dtype.p or len(whole.lstrip("0")) > dtype.p - dtype.s:
                    raise TypeMismatch(f"'{text}' does not fit {dtype}")
                return value
            case "varchar":
                if len(text) > dtype.p:
                    raise TypeMismatch(f"'{text}' is longer than {dtype}")
                return text
            case "text":
                return text
            case "date":
                if not re.fullmatch(r"\d{4}-\d{1,2}-\d{1,2}", text):
                    raise bad
                return dt.date(*map(int, text.split("-")))
            case "timestamp":
                if not re.fullmatch(r"\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{1,2}:\d{1,2}", text):
                    raise bad
                return dt.datetime(*map(int, re.split(r"[-T: ]", text)))
            case "uuid":
                return str(uuid.UUID(text))
            case "json":
                return canonical_json(json.loads(text))
            case "blob":
                return bytes.fromhex(text[2:] if text[:2] in ("0x", "0X") else text)
    except (KeyError, ValueError, InvalidOperation):
        raise bad from None
    raise bad


def shown(value, dtype: DType) -> str:
    """A value as text: trailing zeros of decimals go, blobs are 0x and upper-case hex, NULL is the word null."""
    if value is None:
        return "null"
    match dtype.name:
        case "bool":
            return "true" if value else "false"
        case "decimal" | "bigint":
            text = format(Decimal(value), "f")
            return text.rstrip("0").rstrip(".") if "." in text else text
        case "timestamp":
            return value.strftime("%Y-%m-%d %H:%M:%S")
        case "blob":
            return "0x" + bytes(value).hex().upper()
    return str(value)


def wire(value, dtype: DType):
    """A value as JSON: numbers and booleans as such, wide numbers as text, json nested, blobs as lists of bytes."""
    if value is None:
        return None
    match dtype.name:
        case "bool" | "int":
            return value
        case "json":
            return json.loads(value)
        case "blob":
            return list(bytes(value))
    return shown(value, dtype)
