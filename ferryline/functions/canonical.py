"""Values as they are hashed: one tagged text for each, the same whatever engine, collation or key order it came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXTUAL = ("char", "varchar", "tinytext", "text", "mediumtext", "longtext", "enum", "set", "json")
_INTEGERS = {T.ByteType: "int64", T.ShortType: "int64", T.IntegerType: "int64", T.LongType: "int64"}


def declared(field: T.StructField) -> str:
    """The column type a field was declared with, from its metadata; by its Spark type where nothing says."""
    given = (field.metadata or {}).get("mysql_type")
    if given:
        return given.lower()
    return "varchar" if isinstance(field.dataType, (T.StringType, T.VariantType)) else "varbinary" if isinstance(field.dataType, T.BinaryType) else field.dataType.simpleString()


def valid_json(text: Column, kind: str) -> Column:
    """Is a value compared as JSON: any of a JSON column, or what looks like an object or array in a text column?"""
    t = F.trim(text)
    if kind not in TEXTUAL:
        return F.lit(False)
    parses = F.try_parse_json(t).isNotNull()
    return parses if kind == "json" else (t.startswith("{") | t.startswith("[")) & parses


def text_value(text: Column, kind: str) -> Column:
    canonical = F.to_json(F.try_parse_json(F.trim(text)))
    return F.when(valid_json(text, kind), F.concat(F.lit("json:"), canonical)).otherwise(F.concat(F.lit("string:"), text))


def value(column: Column, field: T.StructField) -> Column:
    """The tagged text of one column: integers have one tag at every width, decimals travel as strings."""
    kind, t = declared(field), field.dataType
    if isinstance(t, T.BinaryType):
        shown = text_value(F.decode(column, "UTF-8"), kind) if kind in TEXTUAL else F.concat(F.lit("bytes:"), F.base64(column))
    elif isinstance(t, T.StringType):
        shown = text_value(column, kind)
    elif isinstance(t, T.BooleanType):
        shown = F.concat(F.lit("bool:"), column.cast("string"))
    elif type(t) in _INTEGERS:
        shown = F.concat(F.lit(f"{_INTEGERS[type(t)]}:"), column.cast("string"))
    elif isinstance(t, T.DecimalType):
        shown = F.concat(F.lit("string:"), column.cast("string"))
    elif isinstance(t, T.FloatType):
        shown = F.concat(F.lit("float32:"), number(column))
    elif isinstance(t, T.DoubleType):
        shown = F.concat(F.lit("float64:"), number(column))
    elif isinstance(t, T.TimestampType):
        shown = F.concat(F.lit("time:"), stamp(F.to_utc_timestamp(column, F.current_timezone())))
    elif isinstance(t, (T.TimestampNTZType, T.DateType)):
        shown = F.concat(F.lit("time:"), stamp(column.cast("timestamp_ntz")))
    elif isinstance(t, T.VariantType):
        shown = F.concat(F.lit("json:"), F.to_json(column))
    else:
        raise TypeError(f"incompatible_for_hash: column {field.name} has type {t.simpleString()}")
    return F.coalesce(shown, F.lit("null:"))


def number(column: Column) -> Column:
    """Shortest text that reads back as the same number: plain from 1e-4 up to 1e21, else with an exponent; no trailing ``.0``."""
    text = column.cast("string")
    mantissa = F.regexp_replace(F.regexp_extract(text, r"^-?([0-9.]+)", 1), r"\.0$", "")
    digits = F.regexp_replace(mantissa, r"\.", "")
    plain = F.regexp_replace(text, r"\.0$", "")
    power = F.coalesce(F.regexp_extract(text, r"E(-?\d+)$", 1).try_cast("int"), F.lit(0))
    sign = F.when(text.startswith("-"), "-").otherwise("")
    moved = F.when(power >= 0, F.concat(sign, F.substring(F.rpad(digits, 400, "0"), F.lit(1), power + 1), F.when(F.length(digits) > power + 1, F.concat(F.lit("."), F.substring(digits, power + 2, F.lit(400)))).otherwise(""))).otherwise(F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits))
    written = F.concat(sign, mantissa, F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.length(F.abs(power).cast("string")), F.lit(2)), F.lit("0")))
    return F.when(~text.contains("E"), plain).when((power >= 21) | (power < -4), written).otherwise(moved)


def stamp(wall: Column) -> Column:
    """A time in UTC, its fraction without trailing zeros."""
    return F.concat(F.date_format(wall, "yyyy-MM-dd'T'HH:mm:ss"), F.regexp_replace(F.regexp_replace(F.date_format(wall, ".SSSSSS"), "0+$", ""), r"^\.$", ""), F.lit("Z"))


def row_digest(df: DataFrame, columns: list[str] | None = None) -> Column:
    """SHA-256, in lower-case hex, of the row's tagged values as a JSON array of strings."""
    names = columns if columns is not None else df.columns
    tagged = F.array(*(value(F.col(f"`{c}`"), df.schema[c]) for c in names))
    written = F.to_json(tagged)
    for sign in "<>&":  # such signs stand only inside the strings
        written = F.replace(written, F.lit(sign), F.lit(f"\\u{ord(sign):04x}"))
    return F.sha2(written, 256)
