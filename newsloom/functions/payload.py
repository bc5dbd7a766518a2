"""Fields of source payloads, kept as JSON text or as variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def payload_field(df: DataFrame, column: str, path: str, kind: str = "string") -> Column:
    """The field at ``path`` of a payload column of ``df``; null where it isn't there or isn't of that kind. A variant isn't parsed again for each field, as text is."""
    if isinstance(df.schema[column].dataType, T.VariantType):
        return F.try_variant_get(F.col(column), path, kind)
    return F.get_json_object(F.col(column), path).try_cast(kind)


def is_breaking_payload(df: DataFrame, column: str = "raw_data") -> Column:
    """Whether a payload says that its post is breaking news."""
    flag = F.coalesce(payload_field(df, column, "$.x.breaking", "boolean"), F.lit(False))
    return flag | F.coalesce(payload_field(df, column, "$.youtube.category") == "breaking", F.lit(False))


def payload_schema(df: DataFrame, column: str = "raw_data") -> DataFrame:
    """One row: the schema that all payloads of a variant column have together, as a type of Spark's."""
    return df.agg(F.schema_of_variant_agg(F.col(column)).alias("schema"))
