"""Leaves of nested JSON at a dotted path, through arrays of any depth.

Values are VARIANT.  Named keys step into objects; arrays are passed through wherever they stand, however deep.
json_leaves() gives the same leaves as rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once, for bodies that use it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))

def variant(column: Column, kind: str) -> Column:
    return column if kind == "variant" else F.try_parse_json(column)


def path_text(path: list[str]) -> str:
    return "$" + "".join('["' + p.replace("\\", "\\\\").replace('"', '\\"') + '"]' for p in path)


def _is_array(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("ARRAY")


def _flat(values: Column) -> Column:
    """An array of variants with inner arrays taken apart: once for all rows, as often as it takes where more are left."""

    def apart(held: Column) -> Column:
        return F.flatten(F.transform(held, lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))))

    def deeper(held: Column) -> Column:
        # no more arrays stand in one another than opening brackets in a value
        brackets = F.array_max(F.transform(held, lambda v: F.length(F.regexp_replace(F.to_json(v), r"[^\[]", ""))))
        return F.reduce(F.sequence(F.lit(1), brackets), held, lambda found, _: F.when(F.exists(found, _is_array), apart(found)).otherwise(found))

    once = apart(values)
    return let(once, lambda held: F.when(F.exists(held, _is_array), deeper(held)).otherwise(held))


def leaves(value: Column, path: list[str]) -> Column:
    """The values at the path as an array of variants: no arrays, null where JSON has null."""
    found = _flat(F.filter(F.array(value), lambda v: v.isNotNull()))
    for name in path:
        found = F.transform(found, lambda v: F.try_variant_get(v, path_text([name]), "variant"))
        found = _flat(F.filter(found, lambda v: v.isNotNull()))
    return found


def kind_of(v: Column) -> Column:
    """STRING, BOOLEAN, VOID, OBJECT, or NUMBER."""
    kind = F.schema_of_variant(v)
    number = kind.rlike("^(?:BIGINT|DOUBLE|DECIMAL|INT|SMALLINT|TINYINT|FLOAT)")
    return F.when(number, "NUMBER").when(kind.startswith("OBJECT"), "OBJECT").otherwise(kind)


def json_leaves(df: DataFrame, pk: str, column: str, path: list[str]) -> DataFrame:
    """(pk, leaf): leaves() as rows, for arrays nested without bound.

    Each row is walked by itself: a recursive query stops at a million rows of all steps together.
    """
    return df.select(pk, F.explode(leaves(F.col(column), path)).alias("leaf"))
