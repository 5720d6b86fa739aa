"""Casts, missing values, guarded ratios and code names as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What a text may look like to count as a number. Spark's own cast also takes
# Java suffixes and hexadecimal floats ("1d", "0x1p3"), which are not numbers here.
NUMBER_TEXT = (
    r"(?i)^\s*[+-]?(\d+(\.\d*)?(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity|nan)\s*$"
)


def named(name: str) -> Column:
    """A column by its literal name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def missing_to_null(value: Column) -> Column:
    """NaN counts as missing everywhere, as null does."""
    return F.nanvl(value, F.lit(None).cast("double"))


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.NumericType, T.BooleanType))


def as_feature(field: T.StructField) -> Column:
    """One feature as double, missing as null, under its own name."""
    value = named(field.name)
    if isinstance(field.dataType, T.StringType):
        value = lenient_double(value)
    elif not isinstance(field.dataType, T.DoubleType):
        value = value.cast("double")
    if isinstance(field.dataType, (T.FloatType, T.DoubleType, T.StringType)):
        value = missing_to_null(value)
    return value.alias(field.name)


def lenient_double(text: Column) -> Column:
    """Text to double; whatever is no number becomes null instead of an error."""
    return F.when(text.rlike(NUMBER_TEXT), text.try_cast("double"))


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` in double; 0 where the denominator is 0."""
    whole = whole.cast("double")
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole)


def code_name(code: Column, names: Mapping[int, str]) -> Column:
    """Name of an integer code; an unknown code is its own name, null stays null."""
    code = code.cast("int")
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, code), code.cast("string"))
