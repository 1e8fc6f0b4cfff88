"""Semi-structured columns: JSON texts as VARIANT, fields taken out by path and type, schemas found by one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(rows: DataFrame, column: str, name: str = "variant", flag: str = "malformed") -> DataFrame:
    """Adds the text's value, and whether it is no JSON; of a null text both are null, a JSON null is a value."""
    return rows.withColumn(name, F.try_parse_json(column)).withColumn(flag, F.when(F.col(column).isNotNull(), F.col(name).isNull()))


def field(variant: str | Column, path: str, kind: str) -> Column:
    """The value at a path such as $.a[0].b as `kind`; null where it isn't there or isn't of a sort that casts to it."""
    return F.try_variant_get(variant, path, kind)


def fields(rows: DataFrame, variant: str, wanted: dict[str, tuple[str, str]]) -> DataFrame:
    """Adds a column for each name of {name: (path, kind)}."""
    return rows.withColumns({name: field(variant, path, kind) for name, (path, kind) in wanted.items()})


def schema_found(rows: DataFrame, variant: str, by: list[str] | None = None) -> DataFrame:
    """by..., schema: what holds for all values of each group; fields that some lack are among them."""
    return rows.groupBy(*(by or [])).agg(F.schema_of_variant_agg(variant).alias("schema"))
