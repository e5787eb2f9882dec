"""Boosts by numbers, conditions, age and conversions.

score = (lexical + conversions) * (sum of the present functions, or 1) * (product of the multiplying ones)
Values that can't be scored raise an error, and only rows that match are scored.
"""

from __future__ import annotations

import datetime as dt
import functools
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import notices
from ..errors import InvalidQueryError, UnsupportedError
from ..functions import jsonpath
from ..functions.dates import instant_micros, micros, utc
from ..sources.model import SearchModel
from .filters import Filters

NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")
MODIFIERS = {
    "none": lambda x: x,
    "log": F.log10,
    "log1p": lambda x: F.log10(x + 1),
    "log2p": lambda x: F.log10(x + 2),
    "ln": F.ln,
    "ln1p": lambda x: F.ln(x + 1),
    "ln2p": lambda x: F.ln(x + 2),
    "square": lambda x: x * x,
    "sqrt": F.sqrt,
    "reciprocal": lambda x: F.lit(1.0) / x,
}
#: The least input of modifiers that have one (exclusive for logarithms and the reciprocal).
DOMAIN = {"log": 0.0, "ln": 0.0, "log1p": -1.0, "ln1p": -1.0, "log2p": -2.0, "ln2p": -2.0}


def _failed(reason: str) -> Column:
    return F.raise_error(F.lit(reason)).cast("double")


def number(model: SearchModel, name: str) -> Column:
    """A field's number: of arrays and JSON the least; numeric strings in JSON count, '' is missing."""
    head, *path = name.split(".")
    kind = model.column_type(head)
    column = F.col(f"`{head}`")
    if path or head in model.json or kind == "variant":
        values = F.transform(jsonpath.leaves(jsonpath.variant(column, kind), path), lambda v: F.when(jsonpath.kind_of(v).isin("NUMBER", "STRING"), F.nullif(F.try_variant_get(v, "$", "string"), F.lit(""))))
        return F.array_min(F.transform(F.filter(values, lambda s: s.isNotNull()), lambda s: F.coalesce(s.try_cast("double"), _failed("a boost isn't a number"))))
    if kind.startswith("array"):
        return F.array_min(column).cast("double")
    if kind not in NUMBERS and not kind.startswith("decimal"):
        raise InvalidQueryError(f"{name!r} holds no numbers")
    return column.cast("double")


def modified(value: Column, modifier: str) -> Column:
    if modifier not in MODIFIERS:
        raise InvalidQueryError(f"unknown modifier {modifier!r}")
    out = MODIFIERS[modifier](value)
    if modifier in DOMAIN:
        out = F.when(value > DOMAIN[modifier], out).when(value.isNotNull(), _failed("a boost is out of its modifier's range"))
    if modifier == "reciprocal":
        out = F.when(value != 0, out).when(value.isNotNull(), _failed("a boost divides by zero"))
    bad = F.isnan(out) | (out < 0)
    return F.when(out.isNull(), F.lit(None)).when(bad, _failed("a boost is below 0")).otherwise(out)


def by_number(model: SearchModel, option) -> tuple[list[Column], list[Column]]:
    """(summed, multiplied) functions of boost_by: names, a list of them, or {name: options}."""
    entries = {option: {}} if isinstance(option, str) else {n: {} for n in option} if isinstance(option, (list, tuple)) else option
    summed, multiplied = [], []
    for name, options in (entries or {}).items():
        options = options or {}
        if unknown := set(options) - {"factor", "modifier", "missing", "boost_mode"}:
            raise InvalidQueryError(f"unknown boost options: {', '.join(sorted(unknown))}")
        times = options.get("boost_mode") == "multiply"
        value = number(model, name)
        if options.get("missing") is not None:
            value = F.coalesce(value, F.lit(float(options["missing"])))
        scored = modified(value * float(options.get("factor", 1)), options.get("modifier") or ("none" if times else "ln2p"))
        (multiplied if times else summed).append(scored)
    return summed, multiplied


def by_condition(model: SearchModel, option: dict | None) -> list[Column]:
    """boost_where: {field: value}, {field: {value:, factor:}} or lists of those; the usual factor is 1000."""
    out = []
    for name, value in (option or {}).items():
        entries = value if isinstance(value, list) and value and all(isinstance(v, dict) and "value" in v for v in value) else [value]
        for entry in entries:
            given = isinstance(entry, dict) and "value" in entry
            wanted, factor = (entry["value"], entry.get("factor", 1000)) if given else (entry, 1000)
            if isinstance(factor, bool) or not isinstance(factor, (int, float)) or not math.isfinite(factor) or factor < 0:
                raise InvalidQueryError("factors are numbers from 0")
            if factor:
                out.append(F.when(Filters(model).condition({name: wanted}), F.lit(float(factor))))
    return out


def _span(value, name: str) -> int:
    """An interval in microseconds: a text or a timedelta, or 0."""
    if isinstance(value, bool) or not isinstance(value, (str, dt.timedelta)) and value != 0:
        raise InvalidQueryError(f"recency's {name} is an interval such as 7d")
    return micros(value)


def by_age(model: SearchModel, option: dict | None) -> list[tuple[Column, float]]:
    """boost_by_recency: (function, factor) of each field, falling from its factor with the distance to origin."""
    out = []
    for name, options in (option or {}).items():
        if "." in name:
            raise UnsupportedError("recency takes no JSON path")
        kind = model.column_type(name)
        shape, factor, decay = options.get("function", "gauss"), float(options.get("factor", 1)), float(options.get("decay", 0.5))
        if shape not in ("gauss", "exp", "linear") or not 0 < decay < 1 or factor < 0:
            raise InvalidQueryError("recency takes gauss, exp or linear, a decay between 0 and 1 and a factor from 0")
        scale, offset = _span(options.get("scale"), "scale"), _span(options.get("offset", 0), "offset")
        if scale <= 0 or offset < 0:
            raise InvalidQueryError("recency takes a scale above 0 and an offset from 0")
        origin = instant_micros(options.get("origin") or dt.datetime.now(dt.UTC))
        column = F.col(f"`{name}`")

        def distance(v: Column, of: str, origin=origin, offset=offset) -> Column:
            return F.greatest(F.abs(F.unix_micros(utc(v, of)) - F.lit(origin)) - F.lit(offset), F.lit(0)).cast("double")

        inner = kind.removeprefix("array<").removesuffix(">")
        if not any(inner.startswith(k) for k in ("date", "timestamp")):
            raise InvalidQueryError(f"{name!r} holds no dates")
        far = F.array_min(F.transform(column, lambda v: distance(v, inner))) if kind.startswith("array") else distance(column, kind)
        away = far / F.lit(float(scale))
        shaped = {
            "gauss": F.exp(F.lit(math.log(decay)) * away * away),
            "exp": F.exp(F.lit(math.log(decay)) * away),
            "linear": F.greatest(F.lit(0.0), 1 - F.lit(1 - decay) * away),
        }[shape]
        out.append((F.coalesce(shaped, F.lit(1.0)) * factor, factor))
    return out


def by_conversions(model: SearchModel, columns, term: str, legacy: bool, factor: float = 1.0) -> Column:
    """The conversions of a term in JSON objects of counts: any spelling of the case for legacy ones, else the exact key."""
    total = F.lit(0.0)
    for name in columns:
        kind = model.column_type(name)
        column = F.col(f"`{name}`")
        text = F.to_json(column) if kind == "variant" or kind.startswith("map") else column
        counts = F.from_json(text, "map<string,string>")
        wanted = term.lower()
        hits = F.filter(F.map_entries(counts), lambda e: (F.lower(e["key"]) == wanted) if legacy else (e["key"] == term))

        def value(e: Column) -> Column:
            n = e["value"].try_cast("double")
            return F.when(n.isNull() | F.isnan(n) | (n < 0) | (n == float("inf")), _failed("a conversion count isn't a number from 0")).otherwise(n)

        total = total + F.coalesce(F.aggregate(hits, F.lit(0.0), lambda a, e: a + value(e)), F.lit(0.0)) * factor
    return total


def composed(model: SearchModel, base: Column, options: dict) -> Column:
    """base * (sum group) * (product group)."""
    boost_by = options.get("boost_by") or {}
    if isinstance(boost_by, str):
        boost_by = {boost_by: {}}
    elif isinstance(boost_by, (list, tuple)):
        boost_by = {n: {} for n in boost_by}
    if options.get("boost"):
        boost_by = {**{n: o for n, o in boost_by.items() if n != options["boost"] or (o or {}).get("boost_mode") == "multiply"}, options["boost"]: {}}
    summed, multiplied = by_number(model, boost_by)
    if summed or multiplied or options.get("boost_where"):
        notices.warn(model.name, "boosts score every match before the page is cut")
    summed += by_condition(model, options.get("boost_where"))
    ages = by_age(model, options.get("boost_by_recency"))
    if len(ages) == 1 and not summed:
        summed = [ages[0][0]]
    else:
        summed += [f for f, factor in ages if factor]
    score = base
    if summed:
        present = functools.reduce(lambda a, b: a | b, [f.isNotNull() for f in summed])
        added = functools.reduce(lambda a, b: a + b, [F.coalesce(f, F.lit(0.0)) for f in summed])
        score = score * F.when(present, added).otherwise(1.0)
    for f in multiplied:
        score = score * F.coalesce(f, F.lit(1.0))
    return score
