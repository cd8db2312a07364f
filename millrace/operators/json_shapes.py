"""JSON whose shape is not known: which paths occur, of what kinds, and their values as columns.

One scan merges the schemas of all rows, which is as large as the number of paths,
not of rows. A second scan parses each row once and counts kinds by path; counts are
added up per task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DataType, StructType

# How the kinds of JSON begin in Spark's schemas of variants.
KINDS = [("OBJECT", "object"), ("ARRAY", "array"), ("STRING", "string"), ("BOOLEAN", "boolean"), ("VOID", "null")]


def merged_schema(df: DataFrame, column: str) -> DataType | None:
    """The type that holds all objects of a column of JSON texts; None if no row is JSON."""
    found = df.select(F.schema_of_variant_agg(F.try_parse_json(column))).first()[0]
    if found is None or found == "VOID":
        return None
    # Objects are structs in Spark's own types; names in backticks stay as they are.
    parts = re.split(r"(`(?:[^`]|``)*`)", found)
    return DataType.fromDDL("".join(p if i % 2 else p.replace("OBJECT<", "STRUCT<") for i, p in enumerate(parts)))


def paths_of(kind: DataType | None, path: str = "$") -> Iterator[str]:
    """The paths of a type, `$` for the whole; what is in arrays is not gone into.

    A name that holds both sorts of quotes cannot be written as a path and is left out.
    """
    yield path
    if isinstance(kind, StructType):
        for field in kind.fields:
            quote = next((q for q in "'\"" if q not in field.name), None)
            if quote is not None:
                plain = re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", field.name)
                step = f".{field.name}" if plain else f"[{quote}{field.name}{quote}]"
                yield from paths_of(field.dataType, path + step)


def _kind(value: Column) -> Column:
    schema = F.schema_of_variant(value)
    kind = F.when(value.isNull(), None)
    for start, name in KINDS:
        kind = kind.when(schema.startswith(start), name)
    return kind.otherwise("number")


def kinds_by_path(df: DataFrame, column: str) -> DataFrame:
    """path, kind, n_rows: how many rows have a value of each kind at each path.

    Kinds are object, array, string, number, boolean and null. Texts that are no JSON
    count as `malformed` at `$`; null texts do not count. Of a name that an object
    has twice Spark takes the text for malformed. Where an object at a path is in other
    rows something else, its names are still found if all objects agree with each other.
    """
    paths = list(paths_of(merged_schema(df, column)))
    rows = df.where(F.col(column).isNotNull()).select(F.try_parse_json(column).alias("value"))
    each = F.array(
        *[
            F.struct(F.lit(p).alias("path"), _kind(F.variant_get("value", p, "variant")).alias("kind"))
            for p in paths
        ]
    )
    malformed = F.array(F.struct(F.lit("$").alias("path"), F.lit("malformed").alias("kind")))
    found = rows.select(F.explode(F.when(F.col("value").isNull(), malformed).otherwise(each)).alias("at"))
    return found.where("at.kind is not null").groupBy("at.path", "at.kind").agg(F.count(F.lit(1)).alias("n_rows"))


def shredded(df: DataFrame, column: str, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """`df` with typed columns: for each name the path and the type of a value.

    Values that are missing or do not fit the type, and rows that are no JSON, are null.
    """
    value = F.try_parse_json(column)
    return df.withColumns({n: F.try_variant_get(value, path, kind) for n, (path, kind) in columns.items()})
