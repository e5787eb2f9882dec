"""where: filter dictionaries as one boolean Column.

Every negation keeps rows where the condition is null.  Arrays match by their elements, dotted paths by the leaves of JSON.
"""

from __future__ import annotations

import datetime as dt
import functools
import math
import operator
from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import notices
from ..errors import InvalidQueryError, UnsupportedError
from ..functions import jsonpath
from ..functions.patterns import java_regex, like_pattern
from ..sources.model import SearchModel


@dataclass(frozen=True)
class Between:
    """A range; None or infinity leaves a side open, exclusive leaves the end out."""

    low: Any = None
    high: Any = None
    exclusive: bool = False


COMPARE = {"gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}
PATTERNS = ("like", "ilike", "prefix", "regexp")
OPERATORS = (*COMPARE, *PATTERNS, "in", "all", "not", "_not", "exists")


def negated(condition: Column) -> Column:
    return ~F.coalesce(condition, F.lit(False))


def every(conditions: list[Column]) -> Column:
    return functools.reduce(operator.and_, conditions) if conditions else F.lit(True)


def some(conditions: list[Column]) -> Column:
    return functools.reduce(operator.or_, conditions) if conditions else F.lit(False)


def _scalar(value) -> None:
    if not (value is None or isinstance(value, (str, int, float, bool, Decimal, dt.date, dt.datetime))):
        raise InvalidQueryError(f"{value!r} can't be filtered by")


def _pattern(kind: str, column: Column, value) -> Column:
    if not isinstance(value, str):
        raise UnsupportedError(f"{kind} takes a string")
    if kind == "like":
        return column.like(like_pattern(value))
    if kind == "ilike":
        return column.ilike(like_pattern(value))
    if kind == "prefix":
        return column.startswith(value)
    return column.rlike(java_regex(value))


def _bounds(value: Between) -> list[tuple[str, Any]]:
    closed = lambda x: x is not None and not (isinstance(x, float) and math.isinf(x))
    out = [("gte", value.low)] if closed(value.low) else []
    return out + ([("lt" if value.exclusive else "lte", value.high)] if closed(value.high) else [])


class Filters:
    """Compiles filters of one model."""

    def __init__(self, model: SearchModel):
        self.model = model

    def condition(self, where: dict | None) -> Column:
        if where is None:
            return F.lit(True)
        if not isinstance(where, dict):
            raise InvalidQueryError("where takes a dictionary")
        return every([self._entry(k, v) for k, v in where.items()])

    def _groups(self, value) -> list[Column]:
        if not isinstance(value, (list, tuple)):
            raise InvalidQueryError("a group takes a list")
        return [self.condition(v) for v in value]

    def _entry(self, name: str, value) -> Column:
        if name == "_and":
            return every(self._groups(value))
        if name == "_or":
            return some(self._groups(value)) if value else F.lit(True)
        if name == "or":
            return every([some(self._groups(group)) if group else F.lit(True) for group in value])
        if name == "_not":
            return every([negated(self._entry(k, v)) for k, v in value.items()])
        if name == "id":
            name = self.model.pk
        head, *path = name.split(".")
        kind = self.model.column_type(head)
        if path or head in self.model.json or kind == "variant":
            if kind not in ("variant", "string"):
                raise InvalidQueryError(f"{head!r} holds no JSON")
            notices.warn(self.model.name, f"the filter on {name!r} reads the JSON of every row; a column of its own could be pushed down")
            return self._compiled(JsonTarget(jsonpath.leaves(jsonpath.variant(F.col(f"`{head}`"), kind), path), path), value)
        column = F.col(f"`{head}`")
        if head in self.model.enums:
            return self._compiled(EnumTarget(column, self.model.enums[head], kind.startswith("array")), value)
        return self._compiled(ArrayTarget(column) if kind.startswith("array") else Target(column), value)

    def _compiled(self, target: Target, value) -> Column:
        if isinstance(value, Between):
            return target.compared(_bounds(value))
        if isinstance(value, (list, tuple, set)):
            return some([target.equals(v) for v in value])
        if not isinstance(value, dict):
            return target.equals(value)
        parts, bounds = [], []
        for op, v in value.items():
            if op in COMPARE:
                _scalar(v)
                bounds.append((op, v))
            elif op == "in":
                parts.append(self._compiled(target, v if isinstance(v, Between) else list(v)))
            elif op == "all":
                parts.append(every([target.equals(x) for x in v]))
            elif op in ("not", "_not"):
                parts.append(negated(self._compiled(target, v)))
            elif op == "exists":
                if not isinstance(v, bool):
                    raise InvalidQueryError("exists takes true or false")
                parts.append(target.present() if v else ~target.present())
            elif op in PATTERNS:
                parts.append(target.matches(op, v))
            else:
                raise InvalidQueryError(f"unknown operator {op!r}; there are {', '.join(OPERATORS)}")
        return every([*([target.compared(bounds)] if bounds else []), *parts])


class Target:
    """A plain column."""

    def __init__(self, column: Column):
        self.column = column

    def equals(self, value) -> Column:
        _scalar(value)
        return self.column.isNull() if value is None else self.column == F.lit(value)

    def present(self) -> Column:
        return self.column.isNotNull()

    def compared(self, bounds) -> Column:
        return every([COMPARE[op](self.column, F.lit(v)) for op, v in bounds])

    def matches(self, kind: str, value) -> Column:
        return _pattern(kind, self.column, value)


class ArrayTarget(Target):
    """An array: one element must meet all of a condition."""

    def _any(self, test: Callable[[Column], Column]) -> Column:
        return F.coalesce(F.exists(self.column, test), F.lit(False))

    def equals(self, value) -> Column:
        _scalar(value)
        return ~self.present() if value is None else F.coalesce(F.array_contains(self.column, F.lit(value)), F.lit(False))

    def present(self) -> Column:
        return self._any(lambda x: x.isNotNull())

    def compared(self, bounds) -> Column:
        return self._any(lambda x: every([COMPARE[op](x, F.lit(v)) for op, v in bounds]))

    def matches(self, kind: str, value) -> Column:
        return self._any(lambda x: _pattern(kind, x, value))


class EnumTarget(Target):
    """Stored numbers with labels: labels and numbers both name a value, ranges and patterns go by label."""

    def __init__(self, column: Column, labels: dict[str, int], is_array: bool):
        super().__init__(column)
        self.labels, self.is_array = labels, is_array

    def _test(self, test: Callable[[Column], Column]) -> Column:
        return F.coalesce(F.exists(self.column, test), F.lit(False)) if self.is_array else test(self.column)

    def _label(self, x: Column) -> Column:
        out = F.lit(None).cast("string")
        for label, stored in self.labels.items():
            out = F.when(x == stored, label).otherwise(out)
        return out

    def equals(self, value) -> Column:
        _scalar(value)
        if value is None:
            return negated(self._test(lambda x: x.isin(*self.labels.values())))
        stored = self.labels.get(value) if isinstance(value, str) else value if value in self.labels.values() else None
        return F.lit(False) if stored is None else self._test(lambda x: x == stored)

    def present(self) -> Column:
        return ~self.equals(None)

    def compared(self, bounds) -> Column:
        return self._test(lambda x: every([COMPARE[op](self._label(x), F.lit(v)) for op, v in bounds]))

    def matches(self, kind: str, value) -> Column:
        return self._test(lambda x: _pattern(kind, self._label(x), value))


class JsonTarget(Target):
    """Leaves at a path of JSON, compared with the type that JSON gave them."""

    def __init__(self, found: Column, path: list[str]):
        super().__init__(found)
        self.path = path

    def _any(self, test: Callable[[Column], Column]) -> Column:
        return F.coalesce(F.exists(self.column, test), F.lit(False))

    @staticmethod
    def _typed(value) -> tuple[str, str]:
        if isinstance(value, bool):
            return "BOOLEAN", "boolean"
        if isinstance(value, (int, float, Decimal)):
            return "NUMBER", "double"
        return "STRING", "string"

    def _value(self, leaf: Column, value) -> Column:
        kind, cast = self._typed(value)
        return F.when(jsonpath.kind_of(leaf) == kind, F.try_variant_get(leaf, "$", cast))

    @staticmethod
    def _literal(value) -> Column:
        if isinstance(value, bool):
            return F.lit(value)
        return F.lit(float(value)) if isinstance(value, (int, float, Decimal)) else F.lit(value.isoformat() if isinstance(value, (dt.date, dt.datetime)) else value)

    def equals(self, value) -> Column:
        _scalar(value)
        if value is None:
            return ~self.present()
        return self._any(lambda x: self._value(x, value) == self._literal(value))

    def present(self) -> Column:
        def filled(x: Column) -> Column:
            text = F.to_json(x)
            scalars = F.regexp_replace(F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"\s*:', ""), r'"(?:[^"\\]|\\.)*"', "1")
            return F.when(jsonpath.kind_of(x) == "OBJECT", scalars.rlike("[0-9]|true|false")).otherwise(jsonpath.kind_of(x) != "VOID")

        return self._any(filled)

    def compared(self, bounds) -> Column:
        return self._any(lambda x: every([COMPARE[op](self._value(x, v), self._literal(v)) for op, v in bounds]))

    def matches(self, kind: str, value) -> Column:
        return self._any(lambda x: _pattern(kind, self._value(x, ""), value))
