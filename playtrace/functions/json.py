"""JSON text to columns, with built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_field(text: Column, name: str, type_name: str) -> Column:
    """One top-level field as ``type_name``; null when missing or not of that type."""
    return F.get_json_object(text, f"$.{name}").try_cast(type_name)


def json_keys(df: DataFrame, column: str, max_keys: int = 2000) -> list[str]:
    """Top-level keys that occur anywhere, sorted. Raises when there are more than a table can hold."""
    found = (
        df.select(F.explode(F.map_keys(F.from_json(F.col(column), "map<string,string>"))).alias("key"))
        .distinct()
        .limit(max_keys + 1)
        .collect()
    )
    if len(found) > max_keys:
        raise ValueError(f"{column} has more than {max_keys} distinct keys; name the ones to expand")
    return sorted(r["key"] for r in found)


def json_expand(
    df: DataFrame, column: str, keys: list[str] | None = None, prefix: str = "", schema: T.StructType | None = None
) -> DataFrame:
    """Add one column per top-level key of a JSON object column; the original columns stay.

    Values are text unless a ``schema`` names the keys and their types. Without keys or schema the keys are
    found in one pass over the data.
    """
    if schema is not None:
        parsed, names = F.from_json(F.col(column), schema), schema.fieldNames()
    else:
        parsed = F.from_json(F.col(column), "map<string,string>")
        names = json_keys(df, column) if keys is None else list(keys)
    fields = [F.col("_parsed")[k].alias(f"{prefix}{k}") for k in names]
    return df.withColumn("_parsed", parsed).select(*df.columns, *fields)
