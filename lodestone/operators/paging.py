"""Orders, offsets and keyset cursors."""

from __future__ import annotations

import base64
import datetime as dt
import functools
import json
import re
import uuid
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidQueryError
from ..sources.model import SearchModel
from ..storage import session_folder

VERSION = 1
UUID = re.compile(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}")


def order_keys(order, pk: str) -> list[tuple[str, bool]]:
    """(name, descending) of an order: a name, {name: direction}, or a list.  _score in a list descends."""
    if order is None:
        return []
    entries = order if isinstance(order, (list, tuple)) else [order]
    out = []
    for entry in entries:
        pairs = entry.items() if isinstance(entry, dict) else [(entry, "desc" if entry == "_score" and isinstance(order, (list, tuple)) else "asc")]
        for name, direction in pairs:
            if isinstance(direction, dict):
                direction = direction.get("order", "asc")
            if str(direction).lower() not in ("asc", "desc"):
                raise InvalidQueryError(f"orders are asc or desc, not {direction!r}")
            out.append((pk if name == "id" else str(name), str(direction).lower() == "desc"))
    return out


def sort_columns(keys: list[tuple[str, bool]], model: SearchModel) -> list[Column]:
    """Nulls last ascending and first descending, with the key as the last word."""
    if not keys:
        keys = [("_score", True)]
    out = []
    for name, down in keys:
        if name != "_score":
            model.column_type(name)
        column = F.col(f"`{name}`")
        out.append(column.desc_nulls_first() if down else column.asc_nulls_last())
    return out if any(n == model.pk for n, _ in keys) else [*out, F.col(f"`{model.pk}`").asc()]


def placed(df: DataFrame, order: list[Column]) -> DataFrame:
    """df with __place, each row's number in the order from 0: sorted by ranges and stored once, then numbered within the
    ranges, whose sizes are the only thing that the driver sees."""
    spark, path = df.sparkSession, session_folder(df.sparkSession, "places")
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranges.withColumn("__at", F.monotonically_increasing_id()).write.parquet(path)
    held = spark.read.parquet(path)
    part = F.shiftright(F.col("__at"), 33)
    before, starts = 0, []
    for r in held.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():
        starts.append((r.part, before))
        before += r.n
    known = F.broadcast(spark.createDataFrame(starts, "__part long, __start long"))
    return held.join(known, part == F.col("__part")).withColumn("__place", F.col("__start") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__at", "__part", "__start")


def keyset_keys(order, model: SearchModel) -> list[tuple[str, bool]]:
    keys = order_keys(order, model.pk)
    names = [n for n, _ in keys]
    if "_score" in names or len(set(names)) != len(names):
        raise InvalidQueryError("a keyset takes each column once and no score")
    for n in names:
        kind = model.column_type(n)
        if not re.match(r"(tinyint|smallint|int|bigint|decimal|string|date|timestamp)", kind):
            raise InvalidQueryError(f"{n!r} can't be a keyset key")
    return keys if model.pk in names else [*keys, (model.pk, False)]


def after_condition(keys: list[tuple[str, bool]], values: list) -> Column:
    """Rows behind the cursor: behind it in the first key, or equal there and behind it in the next, and so on.

    Nulls stand where sort_columns() puts them, last ascending and first descending.
    """
    parts = []
    for k, (name, down) in enumerate(keys):
        same = [F.col(f"`{n}`").eqNullSafe(F.lit(v)) for (n, _), v in zip(keys[:k], values, strict=False)]
        column, value = F.col(f"`{name}`"), values[k]
        if down:
            behind = column.isNotNull() if value is None else column < F.lit(value)
        else:
            behind = F.lit(False) if value is None else (column > F.lit(value)) | column.isNull()
        parts.append(functools.reduce(lambda a, b: a & b, [*same, behind]))
    return functools.reduce(lambda a, b: a | b, parts)


def encode(model: SearchModel, keys: list[tuple[str, bool]], row) -> str:
    def plain(v):
        if isinstance(v, (dt.datetime, dt.date)):
            return v.isoformat()
        return str(v) if isinstance(v, Decimal) else v

    said = {"version": VERSION, "table": model.name, "order": [[n, "desc" if d else "asc"] for n, d in keys], "values": [plain(row[n]) for n, _ in keys]}
    return base64.urlsafe_b64encode(json.dumps(said, separators=(",", ":")).encode()).decode().rstrip("=")


def decode(model: SearchModel, keys: list[tuple[str, bool]], cursor: str) -> list:
    try:
        said = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        given = said["values"]
        fits = said["version"] == VERSION and said["table"] == model.name and said["order"] == [[n, "desc" if d else "asc"] for n, d in keys] and len(given) == len(keys)
    except (ValueError, KeyError, TypeError) as e:
        raise InvalidQueryError("the cursor can't be read") from e
    if not fits:
        raise InvalidQueryError("the cursor belongs to another search")
    if any(v is None and n == model.pk for v, (n, _) in zip(given, keys, strict=True)):
        raise InvalidQueryError("the cursor's values don't fit")
    return [None if v is None else _typed(v, model.column_type(n)) for v, (n, _) in zip(given, keys, strict=True)]


def _typed(value, kind: str):
    try:
        if kind.startswith("decimal"):
            return Decimal(value)
        if kind.startswith("timestamp"):
            return dt.datetime.fromisoformat(value)
        if kind == "date":
            return dt.date.fromisoformat(value)
        if kind == "string":
            if not isinstance(value, str):
                raise ValueError(value)
            return str(uuid.UUID(value)) if UUID.fullmatch(value) else value
        if isinstance(value, bool) or not isinstance(value, int):
            raise ValueError(value)
        return value
    except (ValueError, TypeError, ArithmeticError) as e:
        raise InvalidQueryError("the cursor's values don't fit") from e
