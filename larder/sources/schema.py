"""Find logical product fields in a table whose columns vary.

A logical field has an ordered list of candidate columns. The first one that
exists is used for the whole table; a missing field is a typed NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder import tables

# Type of a field the table does not have.
ABSENT_TYPES = {
    "nova_group": T.IntegerType(),
    "additives_n": T.IntegerType(),
    "unique_scans_n": T.LongType(),
    "ingredients_tags": T.ArrayType(T.StringType()),
    "additives_tags": T.ArrayType(T.StringType()),
    "countries_tags": T.ArrayType(T.StringType()),
} | {name: T.DoubleType() for name in tables.NUTRIENTS}


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def field_column(df: DataFrame, field: str, candidates: dict[str, list[str]]) -> str | None:
    """Name of the first candidate column the table has."""
    return next((c for c in candidates.get(field, []) if c in df.columns), None)


def field(df: DataFrame, name: str, candidates: dict[str, list[str]]) -> tuple[Column, T.DataType]:
    """The field's column and type, or a typed NULL."""
    found = field_column(df, name, candidates)
    if found is None:
        kind = ABSENT_TYPES.get(name, T.StringType())
        return F.lit(None).cast(kind), kind
    return quoted(found), df.schema[found].dataType


def _struct_nutrient(df: DataFrame, name: str, spellings: list[str]) -> Column | None:
    if "nutriments" not in df.columns or not isinstance(df.schema["nutriments"].dataType, T.StructType):
        return None
    names = df.schema["nutriments"].dataType.fieldNames()
    found = next((s for s in spellings if s in names), None)
    return None if found is None else F.col("nutriments").getField(found)


def _flat_nutrient(df: DataFrame, name: str) -> Column | None:
    found = next((s for s in tables.NUTRIENT_SPELLINGS[name] if s in df.columns), None)
    return None if found is None else quoted(found)


def _listed_nutrient(df: DataFrame, name: str) -> Column | None:
    """Largest amount among the list entries that carry one of the nutrient's names."""
    kind = df.schema["nutriments"].dataType if "nutriments" in df.columns else None
    if not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType)):
        return None
    names = kind.elementType.fieldNames()
    amounts = [n for n in ("100g", "value") if n in names]
    if "name" not in names or not amounts:
        return None
    wanted = tables.NUTRIENT_ENTRY_NAMES[name]
    entries = F.filter(F.col("nutriments"), lambda e: F.lower(e["name"].cast("string")).isin(wanted))
    return F.array_max(
        F.transform(entries, lambda e: F.coalesce(*[e[n].try_cast("double") for n in amounts]))
    )


def nutrient(df: DataFrame, name: str, prefer: str = "struct") -> Column | None:
    """A nutrient's column: searching prefers the struct, curation the flat column.

    Curation also reads list-of-struct entries. None when the table lacks it.
    """
    if prefer == "struct":
        options = [_struct_nutrient(df, name, [name]), _flat_nutrient(df, name)]
    else:
        flat = [s for s in tables.NUTRIENT_SPELLINGS[name] if "-" not in s]
        options = [_flat_nutrient(df, name), _struct_nutrient(df, name, flat), _listed_nutrient(df, name)]
    return next((o for o in options if o is not None), None)


def search_projection(df: DataFrame) -> DataFrame:
    """The 16 search fields and 9 nutrients under fixed names."""
    fields = [field(df, name, tables.SEARCH_FIELDS)[0].alias(name) for name in tables.SEARCH_COLUMNS]
    amounts = []
    for name in tables.NUTRIENTS:
        found = nutrient(df, name)
        amounts.append((F.lit(None).cast("double") if found is None else found).alias(name))
    return df.select(*fields, *amounts)
