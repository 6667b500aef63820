"""Strict JSON decoding of log lines: one object per line, no dialect, no type conversion.

Spark's parser is lenient where a log decoder must not be: it accepts single
quotes and NaN, ignores text after the object, and turns numbers and objects
into strings. Here a line is parsed as the only element of an array (text
after the object, or a second object, makes the array invalid or longer), the
dialect options are off, and string fields are read as VARIANT, whose own
type tells a string from anything else.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPTIONS = {
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": "_corrupt_record",
    "allowSingleQuotes": "false",
    "allowNonNumericNumbers": "false",
    "allowUnquotedFieldNames": "false",
    "allowComments": "false",
}


def parse_line(line: Column, fields: str) -> Column:
    """Struct with ``object`` (the line's object, null unless the line is exactly one that fits ``fields``)."""
    text = F.trim(line, F.lit(" \t\r\n"))
    wrapped = F.when(text.startswith("{") & text.endswith("}"), F.concat(F.lit('{"r":['), text, F.lit("]}")))
    return F.from_json(wrapped, f"r array<struct<{fields}>>, _corrupt_record string", OPTIONS)


def object_of(parsed: Column) -> Column:
    """The object of a ``parse_line`` result, or null."""
    return F.when(parsed.getField("_corrupt_record").isNull() & (F.size(parsed.getField("r")) == 1),
                  F.get(parsed.getField("r"), 0))


def with_object(rows: DataFrame, line: Column, fields: str, out: str) -> DataFrame:
    """``rows`` plus ``out``, the object of each line; every line is parsed once.

    The parse alone stands in a Generate: filters above are not pushed below
    it, and what is read from its result is a projection on a column. Inside
    the Generate, each mention of the parse would be a parse of its own.
    """
    parsed = rows.select("*", F.inline(F.array(F.struct(parse_line(line, fields).alias("__parsed")))))
    # A second Generate, so that what reads the object doesn't repeat the look at the parse for each of its fields.
    return parsed.select("*", F.inline(F.array(F.struct(object_of(F.col("__parsed")).alias(out))))).drop("__parsed")


def members(value: Column, names: list[str], path: str = "$") -> Column:
    """The named members of a VARIANT's object as a struct of VARIANTs (null if there is no object)."""
    return F.try_variant_get(value, path, f"struct<{', '.join(f'{n} variant' for n in names)}>")


def is_absent(value: Column) -> Column:
    """Whether a VARIANT is missing or a JSON null."""
    return value.isNull() | F.is_variant_null(value)


def is_long(value: Column) -> Column:
    """Whether a VARIANT field is an integer of 64 bits, null or absent."""
    return value.isNull() | F.schema_of_variant(value).isin("BIGINT", "VOID")


def is_text(value: Column) -> Column:
    """Whether a VARIANT field is a string, null or absent."""
    return value.isNull() | F.schema_of_variant(value).isin("STRING", "VOID")


def all_text(*values: Column) -> Column:
    return reduce(lambda a, b: a & b, map(is_text, values))


def text_of(value: Column) -> Column:
    """The string in a VARIANT field (null if it holds none)."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def is_json_object(line: Column) -> Column:
    """Whether a line is exactly one JSON object."""
    return object_of(parse_line(line, "__any variant")).isNotNull()
