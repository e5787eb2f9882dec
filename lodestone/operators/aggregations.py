"""Facets: terms, metrics, ranges and histograms over the documents that match.

Documents are counted, never rows of an exploded array: values are first reduced to distinct (document, value) pairs,
and since arrays are reduced before they are exploded, that needs no shuffle.
Every facet is one tidy DataFrame; buckets() renders it as dictionaries.
"""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import notices
from ..errors import InvalidQueryError, UnsupportedError
from ..functions.dates import CALENDAR, calendar_floor, date_format, date_text, floor_micros, instant, instant_micros, local_to_utc, micros, utc, zone_name
from ..functions.patterns import java_regex
from ..sources.model import SearchModel

METRICS = ("avg", "min", "max", "sum", "cardinality")
KINDS = ("ranges", "date_ranges", "histogram", "date_histogram", *METRICS)
COMMON = {"field", "where", "missing"}
#: Options of each kind besides the common ones (fixed values).
TAKES = {
    "terms": {"limit", "order", "min_doc_count", "include", "exclude"},
    "ranges": {"keyed"},
    "date_ranges": {"keyed", "time_zone", "format"},
    "histogram": {"interval", "offset", "order", "min_doc_count", "keyed", "extended_bounds", "hard_bounds"},
    "date_histogram": {"interval", "calendar_interval", "fixed_interval", "offset", "order", "min_doc_count", "keyed", "extended_bounds", "hard_bounds", "time_zone", "format"},
} | {m: set() for m in METRICS}


#: Empty buckets that a histogram fills in at most; more raise an error.
MAX_GRID = 1_000_000
#: Buckets that a facet is rendered with at most; as a DataFrame it has no bound.
MAX_BUCKETS = 100_000
#: The least length of calendar units in microseconds (fixed values).
UNIT_MICROS = {"second": 10**6, "minute": 60 * 10**6, "hour": 3600 * 10**6, "day": 23 * 3600 * 10**6, "week": 167 * 3600 * 10**6, "month": 28 * 86400 * 10**6, "quarter": 89 * 86400 * 10**6, "year": 365 * 86400 * 10**6}


def normalised(aggs) -> dict[str, dict]:
    if aggs is None:
        return {}
    if isinstance(aggs, str):
        return {aggs: {}}
    return {n: {} for n in aggs} if isinstance(aggs, (list, tuple)) else {n: dict(o or {}) for n, o in aggs.items()}


def kind_of(name: str, options: dict) -> tuple[str, dict]:
    """(kind, its options with field and where)"""
    found = [k for k in KINDS if k in options]
    if len(found) > 1:
        raise InvalidQueryError(f"aggregation {name!r} has several kinds: {', '.join(found)}")
    kind = found[0] if found else "terms"
    inner = options.get(kind)
    merged = {k: v for k, v in options.items() if k != kind}
    if kind in ("ranges", "date_ranges"):
        merged["ranges"] = inner
    elif isinstance(inner, dict):
        merged |= inner
    allowed = COMMON | TAKES[kind] | ({"ranges"} if kind in ("ranges", "date_ranges") else set())
    if "partition" in str(merged.get("include")):
        raise UnsupportedError("terms partitions aren't offered")
    if unknown := set(merged) - allowed:
        raise InvalidQueryError(f"unknown aggregation options: {', '.join(sorted(unknown))}")
    merged.setdefault("field", name)
    merged["kind"] = kind
    if "." in merged["field"]:
        raise UnsupportedError("aggregations take no JSON path")
    return kind, merged


def values(df: DataFrame, model: SearchModel, options: dict, unique: bool = True) -> tuple[DataFrame, str]:
    """((pk, value), type of value): a row for each document and distinct value; nulls are left out."""
    name = options["field"]
    kind = model.column_type(name)
    column, missing = F.col(f"`{name}`"), options.get("missing")
    if missing is not None and "date" in options.get("kind", ""):
        at = instant(missing, zone_name(options.get("time_zone")))
        missing = at.date() if kind.removeprefix("array<").startswith("date") else at
    if kind.startswith("array"):
        inner = F.filter(F.coalesce(column, F.array().cast(kind)), lambda x: x.isNotNull())
        inner = F.array_distinct(inner) if unique else inner
        if missing is not None:
            inner = F.when(F.size(inner) == 0, F.array(F.lit(missing)).cast(kind)).otherwise(inner)
        return df.select(model.pk, F.explode(inner).alias("value")), kind.removeprefix("array<")[:-1]
    value = column if missing is None else F.coalesce(column, F.lit(missing).cast(kind))
    return df.select(model.pk, value.alias("value")).where("value is not null"), kind


def _ordered(order, default: dict[str, str]) -> list[Column]:
    given = order or default
    if isinstance(given, list):
        given = {k: v for part in given for k, v in part.items()}
    names = {"_key": "key", "_count": "doc_count"}
    if unknown := set(given) - set(names):
        raise InvalidQueryError(f"aggregations order by _key or _count, not {', '.join(map(str, unknown))}")
    out = [F.desc(names[k]) if str(v).lower() == "desc" else F.asc(names[k]) for k, v in given.items()]
    return out + ([] if "_key" in given else [F.asc("key")])


def terms(df: DataFrame, model: SearchModel, options: dict, dictionary: DataFrame) -> DataFrame:
    """key, doc_count, sum_other_doc_count: the documents of eligible terms that the limit leaves out."""
    rows, kind = values(df, model, options)
    counts = rows.groupBy(F.col("value").alias("key")).agg(F.count("*").alias("doc_count"))
    least = options.get("min_doc_count", 1)
    if least == 0:
        known, _ = values(dictionary, model, {"field": options["field"]})
        counts = known.select(F.col("value").alias("key")).distinct().join(counts, "key", "left").select("key", F.coalesce("doc_count", F.lit(0).cast("long")).alias("doc_count"))
    for name, wanted in (("include", True), ("exclude", False)):
        if options.get(name) is None:
            continue
        said = options[name]
        test = F.col("key").cast("string").rlike(java_regex(said)) if isinstance(said, str) else F.col("key").isin(*said) if said else F.lit(False)
        counts = counts.where(test if wanted else ~test)
    counts = counts.where(F.col("doc_count") >= least)
    limit = options.get("limit", 1000)
    # the sum over all terms needs one number, the top terms a bounded sort: no window over every term
    total = counts.agg(F.sum("doc_count").alias("all"))
    top = counts.orderBy(*_ordered(options.get("order"), {"_count": "desc"})).limit(limit)
    shown = top.agg(F.sum("doc_count").alias("shown"))
    rest = total.join(shown).select((F.coalesce("all", F.lit(0)) - F.coalesce("shown", F.lit(0))).cast("long").alias("sum_other_doc_count"))
    return top.join(F.broadcast(rest))


def metric(df: DataFrame, model: SearchModel, kind: str, options: dict) -> DataFrame:
    """value: a double, null over no values except for sum and cardinality."""
    rows, of = values(df, model, options, unique=kind == "cardinality")
    if kind == "cardinality":
        return rows.agg(F.count_distinct("value").cast("double").alias("value"))
    if not any(of.startswith(t) for t in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")):
        raise InvalidQueryError(f"{options['field']!r} holds no numbers")
    value = F.col("value").cast("double")
    found = {"avg": F.avg, "min": F.min, "max": F.max, "sum": F.sum}[kind](value)
    return rows.agg((F.coalesce(found, F.lit(0.0)) if kind == "sum" else found).alias("value"))


def _number_text(x: float) -> str:
    return "*" if x is None else str(float(x))


def ranges(df: DataFrame, model: SearchModel, options: dict, dates: bool) -> DataFrame:
    """key, from, to, doc_count for half-open ranges, all in one pass; a document counts once in each.

    Ranges of dates have from_as_string and to_as_string too, in the zone and format asked for; bounds without an offset
    are local to that zone.
    """
    zone, style = (zone_name(options.get("time_zone")), date_format(options.get("format"))) if dates else ("UTC", "")
    rows, of = values(df, model, options)
    if dates and not of.startswith(("date", "timestamp")):
        raise InvalidQueryError(f"{options['field']!r} holds no dates")
    said = options.get("ranges")
    if not isinstance(said, (list, tuple)) or not said:
        raise InvalidQueryError("ranges takes a list of ranges")
    bounds = []
    for r in said:
        if not isinstance(r, dict) or set(r) - {"from", "to", "key"} or not isinstance(r.get("key", ""), (str, type(None))):
            raise InvalidQueryError("a range takes from, to and a text as key")
        low, high = ((None if r.get(k) is None else instant_micros(r[k], zone) / 1000 if dates else float(r[k])) for k in ("from", "to"))
        texts = [None if x is None else date_text(round(x * 1000), zone, style) if dates else str(x) for x in (low, high)]
        bounds.append((r.get("key") or "-".join(t or "*" for t in texts), low, high, *texts))
    bounds.sort(key=lambda b: (-math.inf if b[1] is None else b[1], math.inf if b[2] is None else b[2]))
    x = F.unix_micros(utc(F.col("value"), of)) / 1000 if dates else F.col("value").cast("double")
    tests = [(F.lit(True) if low is None else x >= low) & (F.lit(True) if high is None else x < high) for _, low, high, _, _ in bounds]
    flags = rows.groupBy(model.pk).agg(*(F.max(t.cast("int")).alias(f"r{k}") for k, t in enumerate(tests))) if model.column_type(options["field"]).startswith("array") else rows.select(*(t.cast("int").alias(f"r{k}") for k, t in enumerate(tests)))
    sums = flags.agg(*(F.coalesce(F.sum(f"r{k}"), F.lit(0)).cast("long").alias(f"r{k}") for k in range(len(tests))))
    shown = [{"key": key, "from": low, "to": high} | ({"from_as_string": first, "to_as_string": last} if dates else {}) for key, low, high, first, last in bounds]
    kinds = {"from": "double", "to": "double"}
    each = F.array(*(F.struct(*(F.lit(v).cast(kinds.get(k, "string")).alias(k) for k, v in b.items()), F.col(f"r{n}").alias("doc_count")) for n, b in enumerate(shown)))
    return sums.select(F.explode(each).alias("b")).select("b.*")


def _bounds(options: dict, name: str, convert) -> tuple | None:
    said = options.get(name)
    if said is None:
        return None
    low, high = (said.get("min"), said.get("max")) if isinstance(said, dict) else said
    return tuple(None if v is None else convert(v) for v in (low, high))


def _date_bounds(options: dict, name: str, unit: str | None, step: int | None, zone: str) -> tuple[int | None, int | None]:
    """Both bounds in microseconds, rounded to the grid without its offset."""
    said = options.get(name) or {}
    if not isinstance(said, dict) or set(said) - {"min", "max"}:
        raise InvalidQueryError(f"{name} of dates takes min and max")
    for v in said.values():
        if isinstance(v, float) and v != int(v):
            raise InvalidQueryError("bounds in milliseconds are whole numbers")
    low, high = (None if said.get(k) is None else instant_micros(said[k], zone) for k in ("min", "max"))
    if low is not None and high is not None and low > high:
        raise InvalidQueryError(f"min of {name} is above max")
    return tuple(None if v is None else floor_micros(v, unit, step, zone) for v in (low, high))


def _bounded_grid(ends: DataFrame, width: Column, step: int) -> DataFrame:
    """ends, or an error if the grid between them has more than MAX_GRID buckets: one task makes it."""
    return ends.where(F.when(width / step <= MAX_GRID, True).otherwise(F.raise_error(F.lit(f"empty buckets need a grid of over {MAX_GRID}: use min_doc_count 1 or a larger interval")).cast("boolean")))


def histogram(df: DataFrame, model: SearchModel, options: dict) -> DataFrame:
    """key, doc_count on the grid ordinal * interval + offset, with empty buckets between the ends."""
    rows, of = values(df, model, options)
    interval, offset = float(options.get("interval") or 0), float(options.get("offset") or 0)
    if not interval > 0 or not math.isfinite(interval):
        raise InvalidQueryError("interval is a number above 0")
    hard, extended = _bounds(options, "hard_bounds", float), _bounds(options, "extended_bounds", float)
    if hard and extended and any(e is not None and h is not None and (e < h if k == 0 else e > h) for k, (e, h) in enumerate(zip(extended, hard, strict=True))):
        raise InvalidQueryError("extended_bounds lie within hard_bounds")
    ordinal = F.floor((F.col("value").cast("double") - offset) / interval).cast("long")
    rows = rows.select(model.pk, ordinal.alias("at"))
    if hard:
        if hard[0] is not None:
            rows = rows.where(F.col("at") * interval >= hard[0])
        if hard[1] is not None:
            rows = rows.where(F.col("at") * interval <= hard[1])
    if model.column_type(options["field"]).startswith("array"):
        rows = rows.distinct()
    counts = rows.groupBy("at").agg(F.count("*").alias("doc_count"))
    least = options.get("min_doc_count", 0)
    if least == 0:
        ends = counts.agg(F.min("at").alias("low"), F.max("at").alias("high"))
        if extended:
            cut = [None if e is None else math.floor((e - offset) / interval) for e in extended]
            ends = ends.select(F.least("low", F.lit(cut[0]).cast("long")).alias("low"), F.greatest("high", F.lit(cut[1]).cast("long")).alias("high"))
        ends = _bounded_grid(ends.where("low is not null and high is not null and low <= high"), F.col("high").cast("double") - F.col("low"), 1)
        grid = ends.select(F.explode(F.sequence("low", "high")).alias("at"))
        counts = grid.join(counts, "at", "left").select("at", F.coalesce("doc_count", F.lit(0).cast("long")).alias("doc_count"))
    counts = counts.where(F.col("doc_count") >= least).select((F.col("at") * F.lit(interval) + offset).alias("key"), "doc_count")
    return counts.orderBy(*_ordered(options.get("order"), {"_key": "asc"}))


def date_histogram(df: DataFrame, model: SearchModel, options: dict) -> DataFrame:
    """key (timestamp), key_as_string (local, with its offset), doc_count, by calendar or fixed intervals in a zone."""
    given = [options[k] for k in ("interval", "calendar_interval", "fixed_interval") if options.get(k)]
    if len(given) != 1:
        raise InvalidQueryError("a date histogram takes one interval")
    zone = zone_name(options.get("time_zone"))
    unit = CALENDAR.get(given[0]) if not options.get("fixed_interval") else None
    if options.get("calendar_interval") and not unit:
        raise InvalidQueryError(f"{given[0]!r} is no calendar unit")
    style = date_format(options.get("format"))
    said = options.get("offset") or 0
    shift = round(said * 1000) if isinstance(said, (int, float)) else micros(said)
    step = None if unit else micros(given[0])
    if step is not None and step <= 0:
        raise InvalidQueryError("interval is above 0")
    origin = None if unit else F.unix_micros(local_to_utc(F.lit("1970-01-01 00:00:00").cast("timestamp"), zone))

    def floor(at: Column) -> Column:
        moved = F.timestamp_micros(F.unix_micros(at) - shift) if shift else at
        if unit:
            return calendar_floor(moved, unit, zone)
        return F.timestamp_micros(F.floor((F.unix_micros(moved) - origin) / F.lit(step)) * F.lit(step) + origin)

    rows, of = values(df, model, options)
    rows = rows.select(model.pk, floor(utc(F.col("value"), of)).alias("at"))
    hard, extended = (_date_bounds(options, k, unit, step, zone) for k in ("hard_bounds", "extended_bounds"))
    if any(e is not None and h is not None and (e < h if k == 0 else e > h) for k, (e, h) in enumerate(zip(extended, hard, strict=True))):
        raise InvalidQueryError("extended_bounds lie within hard_bounds")
    # bounds are rounded as values are, without the offset, and hold for the keys that are shown
    for limit, test in zip(hard, (lambda k, v: k >= v, lambda k, v: k < v), strict=True):
        if limit is not None:
            rows = rows.where(test(F.unix_micros("at") + shift, F.lit(limit)))
    if model.column_type(options["field"]).startswith("array"):
        rows = rows.distinct()
    counts = rows.groupBy("at").agg(F.count("*").alias("doc_count"))
    least = options.get("min_doc_count", 0)
    if least == 0:
        ends = counts.agg(F.min("at").alias("low"), F.max("at").alias("high"))
        cut = [F.lit(None).cast("timestamp") if e is None else F.timestamp_micros(F.lit(e)) for e in extended]
        ends = ends.select(F.least("low", cut[0]).alias("low"), F.greatest("high", cut[1]).alias("high"))
        ends = ends.where("low is not null and high is not null and low <= high")
        ends = _bounded_grid(ends, F.unix_micros("high") - F.unix_micros("low"), step or UNIT_MICROS[unit])
        if unit:
            every = {"quarter": "INTERVAL 3 MONTHS", "week": "INTERVAL 7 DAYS"}.get(unit, f"INTERVAL 1 {unit.upper()}")
            if unit in ("second", "minute", "hour"):
                grid = ends.select(F.explode(F.sequence("low", "high", F.expr(every))).alias("at"))
            else:
                local = ends.select(F.from_utc_timestamp("low", zone).alias("low"), F.from_utc_timestamp("high", zone).alias("high"))
                grid = local.select(F.explode(F.sequence("low", "high", F.expr(every))).alias("local")).select(local_to_utc(F.col("local"), zone).alias("at"))
        else:
            grid = ends.select(F.explode(F.sequence(F.unix_micros("low"), F.unix_micros("high"), F.lit(step).cast("long"))).alias("us")).select(F.timestamp_micros("us").alias("at"))
        grid = grid.union(counts.select("at")).distinct()
        counts = grid.join(counts, "at", "left").select("at", F.coalesce("doc_count", F.lit(0).cast("long")).alias("doc_count"))
    key = F.timestamp_micros(F.unix_micros("at") + shift) if shift else F.col("at")
    counts = counts.where(F.col("doc_count") >= least).select(key.alias("key"), "doc_count")
    counts = counts.orderBy(*_ordered(options.get("order"), {"_key": "asc"}))
    local = F.from_utc_timestamp("key", zone)
    away = F.floor((F.unix_micros(local) - F.unix_micros("key")) / F.lit(60_000_000)).cast("long")
    sign = F.when(away < 0, "-").otherwise("+")
    label = F.when(away == 0, "Z").otherwise(F.concat(sign, F.lpad(F.floor(F.abs(away) / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.abs(away) % 60).cast("string"), 2, "0")))
    shown = F.unix_millis("key").cast("string") if style == "epoch_millis" else F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss.SSS"), label)
    return counts.select("key", shown.alias("key_as_string"), "doc_count")


def aggregate(df: DataFrame, model: SearchModel, name: str, options: dict, dictionary: DataFrame) -> tuple[str, DataFrame]:
    """(kind, facet) of the matching documents df."""
    kind, merged = kind_of(name, options)
    if model.column_type(merged["field"]).startswith("array"):
        notices.warn(model.name, f"the facet {name!r} takes arrays apart for all matches; filters make it cheaper")
    if kind == "date_histogram" and merged.get("min_doc_count", 0) == 0:
        notices.warn(model.name, f"the facet {name!r} fills in empty buckets; with min_doc_count 1 it doesn't")
    if kind == "terms":
        return kind, terms(df, model, merged, dictionary)
    if kind in METRICS:
        return kind, metric(df, model, kind, merged)
    if kind == "histogram":
        return kind, histogram(df, model, merged)
    if kind == "date_histogram":
        return kind, date_histogram(df, model, merged)
    return kind, ranges(df, model, merged, kind == "date_ranges")


def _epoch(value: dt.datetime) -> int:
    return round((value if value.tzinfo else value.replace(tzinfo=dt.UTC)).timestamp() * 1000)


def buckets(kind: str, facet: DataFrame, options: dict) -> dict:
    rows = [r.asDict() for r in facet.limit(MAX_BUCKETS + 1).collect()]
    if len(rows) > MAX_BUCKETS:
        raise InvalidQueryError(f"a facet of over {MAX_BUCKETS} buckets isn't rendered: use agg_frames() or a limit")
    if kind in METRICS:
        return {"value": rows[0]["value"]}
    out = []
    for r in rows:
        key, bucket = r["key"], {"key": r["key"], "doc_count": r["doc_count"]}
        if isinstance(key, bool):
            bucket |= {"key": int(key), "key_as_string": str(key).lower()}
        elif isinstance(key, dt.datetime):
            bucket |= {"key": _epoch(key), "key_as_string": r.get("key_as_string") or key.isoformat(timespec="milliseconds") + "Z"}
        elif isinstance(key, dt.date):
            bucket |= {"key": _epoch(dt.datetime(key.year, key.month, key.day)), "key_as_string": f"{key.isoformat()}T00:00:00.000Z"}
        bucket |= {k: r[k] for k in ("from", "to", "from_as_string", "to_as_string") if r.get(k) is not None}
        out.append(bucket)
    if options.get("keyed"):
        named = {str(b.get("key_as_string", b["key"])): b for b in out}
        return {"buckets": {n: {k: v for k, v in b.items() if k != "key"} for n, b in named.items()} if kind in ("ranges", "date_ranges") else named}
    found: dict = {"buckets": out}
    if kind == "terms":
        found |= {"doc_count_error_upper_bound": 0, "sum_other_doc_count": rows[0]["sum_other_doc_count"] if rows else 0}
    return found


def best_of_group(df: DataFrame, group: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of each group by an order; the limit is pushed below the shuffle, so a large group sends k rows a task."""
    return df.withColumn("__place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("__place") <= k).drop("__place")


def best_with_group_score(df: DataFrame, group: list[str], order: list[Column], score: str = "_score") -> DataFrame:
    """The first row of each group by an order, with the highest score of the group as group_score.

    The two are found apart, the first row as in best_of_group() and the maximum by a partial aggregation, and joined.
    """
    highest = df.groupBy(*group).agg(F.max(score).alias("group_score"))
    return best_of_group(df, group, order).join(highest, group)
