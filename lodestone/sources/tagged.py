"""Tables as text files of tagged values, for moving data in and out: a line is a row, `@ID|` and then a value for each column,
all with tabs between. A value is a letter for its type, a colon, and its text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.types import DType
from ..operators.select import RID
from ..plans.schema import Schema

# The letters of the types; NULL of any type is n.
TAGS = {"bool": "o", "int": "i", "bigint": "g", "decimal": "m", "varchar": "t", "text": "t", "date": "d", "timestamp": "s", "uuid": "u", "json": "j", "blob": "b"}
_ESCAPED = frozenset({"varchar", "text", "json"})
_ID = r"^@\d+\|$"


def _unescaped(raw: Column) -> Column:
    """A pair of backslashes is one; \\t and \\n between such pairs are the characters."""
    parts = F.transform(F.split(raw, r"\\\\"), lambda p: F.replace(F.replace(p, F.lit("\\t"), F.lit("\t")), F.lit("\\n"), F.lit("\n")))
    return F.array_join(parts, "\\")


def _decoded(token: Column, dtype: DType, name: str) -> Column:
    tag, raw = F.substring_index(token, ":", 1), F.regexp_replace(token, r"^[a-z]:", "")
    match dtype.name:
        case "bool":
            value = raw == F.lit("1")
        case "blob":
            value = F.unhex(raw)
        case kind if kind in _ESCAPED:
            value = _unescaped(raw)
        case _:
            value = raw.cast(dtype.spark)
    wrong = F.raise_error(F.concat(F.lit(f"Column '{name}' is {dtype}, and its value is "), F.coalesce(token, F.lit("missing"))))
    return F.when(tag == "n", F.lit(None)).when(tag == TAGS[dtype.name], value).otherwise(wrong.cast(dtype.spark)).cast(dtype.spark)


def read(spark: SparkSession, path: str, schema: Schema) -> DataFrame:
    """Columns c0, c1, ... in the order of the ids, or of the lines where they have none."""
    lines = spark.read.option("lineSep", "\n").text(path).where(F.trim("value") != "")
    tokens = F.split("value", "\t", -1)
    with_id = F.rlike(tokens[0], F.lit(_ID))
    df = lines.select(
        F.when(with_id, F.regexp_extract(tokens[0], r"\d+", 0).cast("long")).otherwise(F.monotonically_increasing_id()).alias("id"),
        F.when(with_id, F.slice(tokens, 2, F.size(tokens))).otherwise(tokens).alias("tokens"),
    )
    size = len(schema.columns)
    counted = F.when(F.size("tokens") == size, F.col("tokens")).otherwise(F.raise_error(F.lit(f"A row has not {size} values")).cast("array<string>"))
    df = df.select("id", counted.alias("tokens")).orderBy("id")
    return df.select(*[_decoded(F.get("tokens", F.lit(i)), c.dtype, c.name).alias(f"c{i}") for i, c in enumerate(schema.columns)])


def _encoded(col: Column, dtype: DType) -> Column:
    match dtype.name:
        case "bool":
            text = F.when(col, F.lit("1")).when(~col, F.lit("0"))
        case "blob":
            text = F.lower(F.hex(col))
        case "decimal":  # without trailing zeros
            text = F.regexp_replace(F.regexp_replace(col.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
        case "timestamp":
            text = F.date_format(col, "yyyy-MM-dd HH:mm:ss")
        case kind if kind in _ESCAPED:
            text = F.replace(F.replace(F.replace(col, F.lit("\\"), F.lit("\\\\")), F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n"))
        case _:
            text = col.cast("string")
    return F.coalesce(F.concat(F.lit(TAGS[dtype.name] + ":"), text), F.lit("n:"))


def write(df: DataFrame, path: str, schema: Schema) -> None:
    """`df` as the store reads it (c0, ... and RID), in the order of the ids."""
    values = [_encoded(F.col(f"c{i}"), c.dtype) for i, c in enumerate(schema.columns)]
    line = F.concat_ws("\t", F.concat(F.lit("@"), F.col(RID).cast("string"), F.lit("|")), *values)
    df.orderBy(RID).select(line.alias("value")).write.option("lineSep", "\n").text(path)
