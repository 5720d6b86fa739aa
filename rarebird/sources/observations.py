"""Observation tables: scan, column roles, cleaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rarebird.functions.columns import as_feature, is_numeric, named
from rarebird.settings import Roles


def load_observations(spark: SparkSession, path: str) -> DataFrame:
    """One row per entity and year, Parquet, any file system Spark can reach."""
    return spark.read.parquet(path)


def role_of(field: T.StructField, roles: Roles = Roles()) -> str:
    """id, label, text, feature, or other (dates and nested types)."""
    if field.name == roles.label:
        return "label"
    if field.name in roles.ids:
        return "id"
    if isinstance(field.dataType, (T.StringType, T.VarcharType, T.CharType)):
        return "text"
    return "feature" if is_numeric(field.dataType) else "other"


def feature_columns(
    df: DataFrame, roles: Roles = Roles(), exclude: Sequence[str] = ()
) -> list[str]:
    """Names of all features in table order, less the excluded ones."""
    return [
        f.name
        for f in df.schema.fields
        if role_of(f, roles) == "feature" and f.name not in exclude
    ]


def column_roles(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Name, type, role and number of present values of every column.

    The counts come from one aggregation over the table, unpivoted afterwards.
    """
    spark = df.sparkSession
    fields = df.schema.fields
    facts = spark.createDataFrame(
        [(f.name, f.dataType.simpleString(), role_of(f, roles)) for f in fields],
        "column string, type string, role string",
    )
    counted = df.agg(*[F.count(named(f.name)).alias(f.name) for f in fields])
    present = counted.unpivot([], [named(f.name) for f in fields], "column", "non_null")
    # Both sides hold one row per column of the table.
    return facts.join(F.broadcast(present), "column")


def clean(
    df: DataFrame,
    roles: Roles = Roles(),
    keep: Sequence[str] = (),
    text: str = "drop",
) -> DataFrame:
    """Drop identifiers and text, cast the label and all features to double.

    ``keep`` names columns to carry along untouched (row key, split).
    ``text="cast"`` reads text columns as numbers instead of dropping them;
    whatever is no number becomes null. Dates and nested columns are dropped.
    """
    if text not in ("drop", "cast"):
        raise ValueError(f"text must be 'drop' or 'cast', not {text!r}")
    wanted = {"feature"} | ({"text"} if text == "cast" else set())
    columns = []
    for field in df.schema.fields:
        if field.name in keep:
            columns.append(named(field.name))
        elif field.name == roles.label:
            columns.append(as_feature(field))
        elif role_of(field, roles) in wanted:
            columns.append(as_feature(field))
    return df.select(*columns)


def labelled(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Rows whose label is known; training and evaluation need one."""
    return df.where(named(roles.label).isNotNull())
