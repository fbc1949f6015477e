"""Results under a destination's own field names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from accountlake.config import Mapping
from accountlake.functions.values import coerce

# Parents whose unknown children are simply absent rather than a mistake.
OPEN_PARENTS = frozenset(("page_signals",))


class MappingError(ValueError):
    """A mapping entry points at a field the results do not have."""


def resolve(schema: T.StructType, path: str) -> tuple[Column, T.DataType] | None:
    """Column and type of a dotted path; null parents give null. None for an unknown signal."""
    parts = path.split(".")
    kind: T.DataType = schema
    for i, part in enumerate(parts):
        if not isinstance(kind, T.StructType):
            raise MappingError(f"'{path}': cannot descend into {kind.simpleString()}")
        if part not in kind.names:
            if i and parts[i - 1] in OPEN_PARENTS:
                return None
            raise MappingError(f"'{path}': no field '{part}'")
        kind = kind[part].dataType
    return F.col(".".join(f"`{p}`" for p in parts)), kind


def property_columns(schema: T.StructType, mapping: Mapping, destination: str) -> dict[str, Column]:
    """Property name -> value, mapped fields first, then the match key as a default."""
    out: dict[str, Column] = {}
    for field in mapping.for_destination(destination):
        found = resolve(schema, field.source)
        if found is not None:
            out[field.targets[destination]] = coerce(*found, field.type, destination)
    key = mapping.match_keys[destination]
    default = match_value(mapping, destination)
    out[key] = F.coalesce(out[key], default) if key in out else default
    return out


def match_value(mapping: Mapping, destination: str) -> Column:
    """What an existing record is found by: a URL where the key is a website, else the domain."""
    if mapping.match_keys[destination].lower() == "website":
        return F.concat(F.lit("https://"), F.col("domain"))
    return F.col("domain")


def build_payloads(results: DataFrame, mapping: Mapping, destination: str) -> DataFrame:
    """One payload per good result; failed results keep their row, with ``error`` and no properties."""
    properties = property_columns(results.schema, mapping, destination)
    ok = F.col("ok")
    return results.select(
        "domain",
        F.lit(mapping.objects[destination]).alias("object_type"),
        F.lit(mapping.match_keys[destination]).alias("match_key"),
        F.when(ok, match_value(mapping, destination)).alias("match_value"),
        F.when(ok, F.struct(*[c.alias(name) for name, c in properties.items()])).alias("properties"),
        F.when(~ok, F.coalesce("error", F.lit("enrichment failed"))).alias("error"),
    )


def field_catalogue(spark: SparkSession, mapping: Mapping, destination: str) -> DataFrame:
    """What would be written where: source path, property name, type, object, match key."""
    rows = [
        (f.source, f.targets[destination], f.type, mapping.objects[destination], mapping.match_keys[destination])
        for f in mapping.for_destination(destination)
    ]
    return spark.createDataFrame(
        rows, "source string, property string, type string, object_type string, match_key string"
    )
