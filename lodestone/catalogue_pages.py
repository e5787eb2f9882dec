"""Registered queries of what a loaded page gives, of how options combine, and of what is refused."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import AWAY, EXACT, NEW_YORK, ORIGIN, TERMS, TOKENS, WIDGETS, agg_query, bm25_sql, documents, events, found, orders, parts, query, scored
from .errors import InvalidQueryError, MissingFieldError, UnsupportedError
from .functions.jsonpath import json_leaves
from .operators import aggregations
from .operators.highlighting import ansi
from .operators.tinql import maybe_quote
from .plans.relation import listeners
from .sources import model as registry
from .sources.model import SearchModel, parquet_model, search
from .storage import session_folder
from .streaming.incremental import index_stream, latest_postings


def rows_query(name: str, make: Callable[[SparkSession, str], list[tuple]], schema: str, sql: str) -> None:
    """A query of rows that are read off a loaded page, which is bounded by its limit."""
    query(name, lambda s, d: s.createDataFrame(make(s, d), schema), sql)


# -- options

query("where_chain", found(lambda s, d: parts(s, d).search("*").where(p_size={"gt": 5}).where(p_size={"lt": 30}).where_not(p_type="SMALL")), "SELECT p_partkey FROM part WHERE p_size > 5 AND p_size < 30 AND (p_type <> 'SMALL' OR p_type IS NULL)")
query("rewhere", found(lambda s, d: parts(s, d).search("*").where(p_size=1).rewhere(p_type="SMALL")), "SELECT p_partkey FROM part WHERE p_type = 'SMALL'")
query("merge_relation", found(lambda s, d: parts(s, d).search("*", where={"p_size": {"lt": 10}}).merge(parts(s, d).search("*", where={"p_type": "SMALL"}))), "SELECT p_partkey FROM part WHERE p_size < 10 AND p_type = 'SMALL'")
query("merge_condition", found(lambda s, d: parts(s, d).search("widget", fields=["p_name"], **EXACT).merge(F.col("p_size") % 2 == 0)), "SELECT p_partkey FROM part WHERE p_size % 2 = 0 AND list_contains(string_split(p_name, ' '), 'widget')")
query("only_options", lambda s, d: parts(s, d).search("*", where={"p_size": 3}, order={"p_retailprice": "desc"}, limit=4).only("term", "where").rows.select("p_partkey"), "SELECT p_partkey FROM part WHERE p_size = 3")
query("except_options", lambda s, d: parts(s, d).search("*", where={"p_size": 3}, order={"p_retailprice": "desc"}, limit=4).except_("where").to_df().select("p_partkey"), "SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 4")
query("order_appended", lambda s, d: parts(s, d).search("*", limit=25).order("p_brand").order({"p_size": "desc"}).to_df().select("p_partkey"), "SELECT p_partkey FROM part ORDER BY p_brand, p_size DESC NULLS FIRST, p_partkey LIMIT 25")
query("reorder", lambda s, d: parts(s, d).search("*", limit=25, order="p_brand").reorder({"p_size": "desc"}, "p_name").to_df().select("p_partkey"), "SELECT p_partkey FROM part ORDER BY p_size DESC NULLS FIRST, p_name, p_partkey LIMIT 25")
query("reselect", lambda s, d: s.createDataFrame([tuple(r.values()) for r in parts(s, d).search("*", select=["p_name"], limit=9, order="id").reselect("p_partkey", "p_brand").results()], "p_partkey long, p_brand string"), "SELECT p_partkey, p_brand FROM part ORDER BY p_partkey LIMIT 9")
query("default_fields", found(lambda s, d: parquet_model(s, f"{d}/part.parquet", pk="p_partkey", searchable=("p_name", "p_type"), default_fields=("p_type",)).search("small", **EXACT)), "SELECT p_partkey FROM part WHERE p_type = 'SMALL'")
query("field_globs", found(lambda s, d: parts(s, d).search("small", fields=["*_type"], **EXACT)), "SELECT p_partkey FROM part WHERE p_type = 'SMALL'")
query("fields_hook", found(lambda s, d: parquet_model(s, f"{d}/part.parquet", pk="p_partkey", fields_hook=lambda: ["p_name"]).search("small", **EXACT)), "SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), 'small')")


def global_search(spark: SparkSession, sf: str) -> DataFrame:
    """Searches of a declared model by its name."""
    registry.models.pop("catalogue_part", None)
    parquet_model(spark, f"{sf}/part.parquet", pk="p_partkey", name="catalogue_part", searchable=("p_name",)).register()
    return search("widget", model="catalogue_part", **EXACT).rows.select("p_partkey")


query("global_search", global_search, "SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), 'widget')")


def cased(spark: SparkSession, sf: str) -> SearchModel:
    df = spark.read.parquet(f"{sf}/part.parquet").withColumn("title", F.when(F.col("p_partkey") % 3 == 0, F.initcap("p_name")).otherwise(F.col("p_name")))
    return SearchModel(df, pk="p_partkey", name="cased", searchable=("title",), case_sensitive=True)


CASED = "SELECT p_partkey FROM part WHERE p_partkey % 3 = 0 AND list_contains(string_split(p_name, ' '), 'widget')"
query("case_sensitive", found(lambda s, d: cased(s, d).search("Widget", **EXACT)), CASED)
query("case_sensitive_index", found(lambda s, d: cased(s, d).with_index(f"{d}/cased").search("Widget", **EXACT)), CASED)
query("fuzzy_prefix2", found(lambda s, d: parts(s, d).search("wibget", fields=["p_name"], misspellings={"edit_distance": 1, "prefix_length": 2})), "SELECT p_partkey FROM part WHERE len(list_filter(string_split(p_name, ' '), lambda x: starts_with(x, 'wi') AND levenshtein(x, 'wibget') <= 1)) > 0")
query("fuzzy_distance0", found(lambda s, d: parts(s, d).search("widget", fields=["p_name"], misspellings={"edit_distance": 0})), "SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), 'widget')")
query("literal_text", found(lambda s, d: parts(s, d).search('"widget" AND (red)', fields=["p_name"], operator="or", **EXACT)), "SELECT p_partkey FROM part WHERE len(list_intersect(string_split(p_name, ' '), ['widget', 'and', 'red'])) > 0")
KEYCAPS = [(1, "press #️⃣ now"), (2, "press # now"), (3, "rate *️⃣"), (4, "hash tag"), (5, None)]
query("keycaps", found(lambda s, d: SearchModel(s.createDataFrame(KEYCAPS, "id long, body string"), name="keys").search("#️⃣", **EXACT)), "SELECT CAST(1 AS BIGINT) AS id")
query("maybe_quoted", lambda s, d: s.createDataFrame([(t, maybe_quote(t)) for t in ("word", "two words", 'say "x"', "AND", "a_b", "c[d]", "")], "said string, quoted string"), "SELECT * FROM (VALUES ('word', 'word'), ('two words', '\"two words\"'), ('say \"x\"', '\"say \\\"x\\\"\"'), ('AND', '\"AND\"'), ('a_b', '\"a\\_b\"'), ('c[d]', '\"c\\[d\\]\"'), ('', '\"\"')) AS v(said, quoted)")


# -- JSON

DEEP = 11


def nested(spark: SparkSession, sf: str) -> SearchModel:
    """Parts with JSON: names in objects in arrays in arrays, and a size eleven arrays deep."""
    doc = F.concat(F.lit('{"a": [{"name": "'), F.col("p_name"), F.lit('"}, [{"name": ['), F.col("p_size"), F.lit(', "'), F.col("p_brand"), F.lit('"]}]], "deep": ' + "[" * DEEP), F.col("p_size").cast("string"), F.lit("]" * DEEP + ', "flag": '), F.when(F.col("p_size") > 25, "true").otherwise("null"), F.lit("}"))
    return SearchModel(spark.read.parquet(f"{sf}/part.parquet").withColumn("doc", doc), pk="p_partkey", name="nested", json=("doc",))


for _name, _where, _sql in (
    ("eq", {"doc.a.name": "red widget"}, "p_name = 'red widget'"),
    ("number", {"doc.a.name": 7}, "p_size = 7"),
    ("prefix", {"doc.a.name": {"prefix": "Brand#1"}}, "starts_with(p_brand, 'Brand#1')"),
    ("like", {"doc.a.name": {"like": "%gizmo"}}, "p_name LIKE '%gizmo'"),
    ("ilike", {"doc.a.name": {"ilike": "RED %"}}, "p_name ILIKE 'red %'"),
    ("regexp", {"doc.a.name": {"regexp": "^(red|old) [a-g]"}}, "regexp_matches(p_name, '^(red|old) [a-g]')"),
    ("deep", {"doc.deep": {"gte": 10, "lt": 12}}, "p_size IN (10, 11)"),
    ("exists", {"doc.flag": {"exists": True}}, "p_size > 25"),
    ("all", {"doc.a.name": {"all": ["red widget", 7]}}, "p_name = 'red widget' AND p_size = 7"),
):
    query(f"filter_json_nested_{_name}", found(lambda s, d, w=_where: nested(s, d).search("*", where=w)), f"SELECT p_partkey FROM part WHERE {_sql}")


query("json_walk", lambda s, d: json_leaves(nested(s, d).df.select("p_partkey", F.parse_json("doc").alias("v")), "p_partkey", "v", ["a", "name"]).select("p_partkey", F.col("leaf").cast("string").alias("leaf")), "SELECT p_partkey, p_name AS leaf FROM part UNION ALL SELECT p_partkey, CAST(p_size AS VARCHAR) FROM part UNION ALL SELECT p_partkey, p_brand FROM part")
query("json_walk_deep", lambda s, d: json_leaves(nested(s, d).df.select("p_partkey", F.parse_json("doc").alias("v")), "p_partkey", "v", ["deep"]).select("p_partkey", F.col("leaf").cast("int").alias("leaf")), "SELECT p_partkey, p_size AS leaf FROM part")


# -- scores

for _name, _sql in (("none", "p_size"), ("log", "log10(p_size)"), ("log2p", "log10(p_size + 2)"), ("ln", "ln(p_size)"), ("ln1p", "ln(p_size + 1)"), ("reciprocal", "1.0 / p_size")):
    query(f"boost_modifier_{_name}", scored(lambda s, d, m=_name: parts(s, d).search("*", where={"p_size": {"gte": 1}}, boost_by={"p_size": {"modifier": m, "boost_mode": "multiply"}})), f"SELECT p_partkey, round(CAST({_sql} AS DOUBLE), 6) AS score FROM part WHERE p_size >= 1")
query("boost_json_number", scored(lambda s, d: events(s, d).search("*", boost_by={"props.k": {"factor": 0.5, "modifier": "none"}})), "SELECT event_id, round(0.5 * CAST(props->>'$.k' AS DOUBLE), 6) AS score FROM events")
query("boost_legacy", scored(lambda s, d: parts(s, d).search("*", boost="p_size", boost_by={"p_size": {"factor": 9}, "p_retailprice": {"modifier": "ln1p"}})), "SELECT p_partkey, round(ln(2 + p_size) + ln(1 + p_retailprice), 6) AS score FROM part")
_YEARS = "greatest(abs(epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1998-01-01')), 0) / ((365.25 + 60) * 86400000000.0)"
query("recency_alone", scored(lambda s, d: orders(s, d).search("*", boost_by_recency={"o_orderdate": {"scale": "14 months", "origin": ORIGIN, "factor": 0}})), "SELECT o_orderkey, 0.0 AS score FROM orders")
query("recency_of_years", scored(lambda s, d: orders(s, d).search("*", boost_by_recency={"o_orderdate": {"scale": "1 year 2 months", "origin": ORIGIN, "function": "exp"}})), f"SELECT o_orderkey, round(pow(0.5, {_YEARS}), 6) AS score FROM orders")
query(
    "boosts_composed",
    scored(lambda s, d: orders(s, d).search("*", where={"o_orderkey": {"lt": 2000}}, boost_by={"o_totalprice": {"modifier": "ln1p"}, "o_custkey": {"modifier": "ln2p", "boost_mode": "multiply"}}, boost_where={"o_orderstatus": {"value": "F", "factor": 4}}, boost_by_recency={"o_orderdate": {"scale": "30d", "offset": "1 day", "origin": ORIGIN, "function": "gauss", "factor": 2}})),
    f"SELECT o_orderkey, round((ln(1 + o_totalprice) + CASE WHEN o_orderstatus = 'F' THEN 4 ELSE 0 END + 2 * pow(0.5, ({AWAY}) * ({AWAY}))) * ln(2 + o_custkey), 6) AS score FROM orders WHERE o_orderkey < 2000",
)
_BM25 = "CASE WHEN f{0} = 0 THEN 0 ELSE ln(1 + (n - d{0} + 0.5) / (d{0} + 0.5)) * f{0} * 2.2 / (f{0} + 1.2 * (0.25 + 0.75 * l{0} / m{0})) END"
query(
    "multi_field_sum",
    scored(lambda s, d: parts(s, d).search("small", fields=["p_name^2", "p_type^5"], **EXACT)),
    "WITH f AS (SELECT p_partkey, len(list_filter(string_split(p_name, ' '), lambda x: x = 'small')) AS f1, len(string_split(p_name, ' ')) AS l1, CAST(p_type = 'SMALL' AS INT) AS f2, len(regexp_extract_all(p_type, '[A-Za-z0-9]+')) AS l2 FROM part), "
    "s AS (SELECT count(*) AS n, avg(l1) AS m1, avg(l2) AS m2, count(*) FILTER (WHERE f1 > 0) AS d1, count(*) FILTER (WHERE f2 > 0) AS d2 FROM f) "
    f"SELECT p_partkey, round(2 * {_BM25.format(1)} + 5 * {_BM25.format(2)}, 6) AS score FROM f, s WHERE f1 + f2 > 0",
)
_WORD = "(SELECT count(*) FROM tok WHERE list_contains(t, '{0}'))"
query("max_score", lambda s, d: documents(s, d).search("thintion estion", operator="or", **EXACT).max_score().select(F.round("max_score", 6).alias("max_score")), bm25_sql("'thintion', 'estion'", "SELECT round(max(x), 6) AS max_score FROM sc WHERE most > 0"))
query("score_inspect", lambda s, d: documents(s, d).search("the licensed", **EXACT).score_inspect().select("field", "word", "documents", "of", "elided"), TOKENS + f"SELECT 'text' AS field, k AS word, d AS documents, n AS \"of\", d * 1.0 / n >= 0.1 AS elided FROM (SELECT 0 AS k, {_WORD.format('the')} AS d UNION ALL SELECT 1, {_WORD.format('licensed')}), (SELECT count(*) AS n FROM tok)")


# -- facets

DATE = {"key": "unix_millis(key)", "key_as_string": "key_as_string", "doc_count": "doc_count"}
agg_query("date_ranges_zone", orders, {"o_orderdate": {"date_ranges": [{"to": "1995-01-01"}, {"from": "1995-01-01", "to": dt.date(1997, 1, 1)}], "time_zone": "America/New_York"}}, "SELECT k AS key, count(*) FILTER (WHERE o_orderdate >= a AND o_orderdate < b) AS doc_count FROM orders, (VALUES ('*-1995-01-01T00:00:00.000-05:00', TIMESTAMP '1900-01-01', TIMESTAMP '1995-01-01 05:00:00'), ('1995-01-01T00:00:00.000-05:00-1997-01-01T00:00:00.000-05:00', TIMESTAMP '1995-01-01 05:00:00', TIMESTAMP '1997-01-01 05:00:00')) AS v(k, a, b) GROUP BY k", TERMS)
agg_query("date_ranges_millis", orders, {"o_orderdate": {"date_ranges": [{"from": 788918400000}], "format": "epoch_millis"}}, "SELECT '788918400000-*' AS key, '788918400000' AS from_as_string, count(*) AS doc_count FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01'", {"key": "key", "from_as_string": "from_as_string", "doc_count": "doc_count"})
agg_query("date_hist_millis", orders, {"o_orderdate": {"date_histogram": {"interval": "year", "format": "epoch_millis", "min_doc_count": 1}}}, "SELECT epoch_ms(date_trunc('year', o_orderdate)::TIMESTAMP) AS key, CAST(epoch_ms(date_trunc('year', o_orderdate)::TIMESTAMP) AS VARCHAR) AS key_as_string, count(*) AS doc_count FROM orders GROUP BY ALL", DATE)
agg_query("date_hist_missing", orders, {"o_orderdate": {"date_histogram": {"interval": "month", "min_doc_count": 1, "missing": "1990-02-03"}}}, "SELECT epoch_ms(date_trunc('month', coalesce(o_orderdate, TIMESTAMP '1990-02-03'))::TIMESTAMP) AS key, count(*) AS doc_count FROM orders GROUP BY 1", {"key": "unix_millis(key)", "doc_count": "doc_count"})
_HARD = {"min": "1995-01-02T10:00:00", "max": "1995-01-05T10:00:00"}
_KEYS = {"key": "unix_millis(key)", "doc_count": "doc_count"}
_DAYS = "WITH c AS (SELECT {0} AS k, count(*) AS n FROM orders GROUP BY 1) SELECT epoch_ms(k) AS key, n AS doc_count FROM c WHERE k >= TIMESTAMP '1995-01-02' AND k < TIMESTAMP '1995-01-05'"
agg_query("date_hist_hard_days", orders, {"o_orderdate": {"date_histogram": {"interval": "1d", "hard_bounds": _HARD, "min_doc_count": 1}}}, _DAYS.format("date_trunc('day', o_orderdate)::TIMESTAMP"), _KEYS)
agg_query("date_hist_hard_fixed", orders, {"o_orderdate": {"date_histogram": {"fixed_interval": "1d", "hard_bounds": _HARD, "min_doc_count": 1}}}, _DAYS.format("date_trunc('day', o_orderdate)::TIMESTAMP"), _KEYS)
agg_query("date_hist_hard_offset", orders, {"o_orderdate": {"date_histogram": {"interval": "1d", "offset": "-6h", "hard_bounds": _HARD, "min_doc_count": 1}}}, _DAYS.format("(date_trunc('day', o_orderdate + INTERVAL 6 HOUR) - INTERVAL 6 HOUR)::TIMESTAMP"), _KEYS)
agg_query("date_hist_extended", orders, {"o_orderdate": {"date_histogram": {"interval": "month", "extended_bounds": {"min": "1990-03-15", "max": "2001-07-02"}}}}, "WITH c AS (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS a, count(*) AS n FROM orders GROUP BY 1) SELECT epoch_ms(g) AS key, coalesce(n, 0) AS doc_count FROM (SELECT unnest(generate_series(TIMESTAMP '1990-03-01', (SELECT greatest(max(a), TIMESTAMP '2001-07-01') FROM c), INTERVAL 1 MONTH)) AS g) LEFT JOIN c ON a = g", _KEYS)
agg_query("date_hist_hour_new_york", events, {"ts": {"date_histogram": {"interval": "1h", "time_zone": "America/New_York", "min_doc_count": 1}}}, f"SELECT epoch_ms(timezone('UTC', timezone('America/New_York', date_trunc('hour', {NEW_YORK.format('ts')})))) AS key, count(*) AS doc_count FROM events GROUP BY 1", _KEYS)


def rendered(name: str, make, aggs: dict, sql: str, **options) -> None:
    """Facets as dictionaries, as JSON with sorted keys."""
    rows_query(name, lambda s, d: [(n, json.dumps(v, sort_keys=True)) for n, v in make(s, d).search("*", aggs=aggs, limit=1, **options).results().aggregations.items()], "name string, facet string", sql)


rendered(
    "aggregations_envelope", parts, {"p_brand": {"where": {"p_size": 3}, "limit": 1}, "n": {"sum": {"field": "p_size"}}},
    "WITH c AS (SELECT p_brand, count(*) AS n FROM part WHERE p_size = 3 GROUP BY 1), t AS (SELECT * FROM c ORDER BY n DESC, p_brand LIMIT 1) SELECT 'p_brand' AS name, '{\"doc_count\": ' || (SELECT count(*) FROM part WHERE p_size = 3) || ', \"p_brand\": {\"buckets\": [{\"doc_count\": ' || n || ', \"key\": \"' || p_brand || '\"}], \"doc_count_error_upper_bound\": 0, \"sum_other_doc_count\": ' || (SELECT sum(n) FROM c) - n || '}}' AS facet FROM t "
    "UNION ALL SELECT 'n', '{\"value\": ' || CAST(sum(p_size) AS DOUBLE) || '}' FROM part",
)
rendered("ranges_keyed", parts, {"p_size": {"ranges": [{"to": 5, "key": "low"}, {"from": 5}], "keyed": True}}, "SELECT 'p_size' AS name, '{\"buckets\": {\"5.0-*\": {\"doc_count\": ' || count(*) FILTER (WHERE p_size >= 5) || ', \"from\": 5.0}, \"low\": {\"doc_count\": ' || count(*) FILTER (WHERE p_size < 5) || ', \"to\": 5.0}}}' AS facet FROM part")
rendered("dates_rendered", orders, {"o_orderdate": {"date_histogram": {"interval": "year", "min_doc_count": 1, "hard_bounds": {"min": "1995-06-01", "max": "1996-06-01"}}}}, "SELECT 'o_orderdate' AS name, '{\"buckets\": [{\"doc_count\": ' || count(*) || ', \"key\": 788918400000, \"key_as_string\": \"1995-01-01T00:00:00.000Z\"}]}' AS facet FROM orders WHERE year(o_orderdate) = 1995")
query("facet_doc_count", lambda s, d: parts(s, d).search("*", aggs={"p_brand": {"where": {"p_size": {"lt": 25}}}}, where={"p_type": "SMALL"}).agg_frames()["p_brand"][2], "SELECT count(*) AS doc_count FROM part WHERE p_type = 'SMALL' AND p_size < 25")
rows_query("facets_of_a_page", lambda s, d: [(n, str(b["key"]), b["doc_count"]) for n, f in parts(s, d).search("*", aggs=["p_type", "p_brand"], where={"p_size": 4}, limit=1).results().aggs.items() for b in f["buckets"]], "name string, key string, doc_count long", "SELECT 'p_type' AS name, p_type AS key, count(*) AS doc_count FROM part WHERE p_size = 4 GROUP BY 2 UNION ALL SELECT 'p_brand', p_brand, count(*) FROM part WHERE p_size = 4 GROUP BY 2")


# -- pages

query("loaded_rows", lambda s, d: parts(s, d).search("*", where={"p_size": 2}, order="p_name").hit_frame().select("_source.p_partkey", "_source.p_name"), "SELECT p_partkey, p_name FROM part WHERE p_size = 2")
rows_query("plucked", lambda s, d: parts(s, d).search("*", order={"p_retailprice": "desc"}, limit=30).pluck("p_partkey", "p_brand"), "p_partkey long, p_brand string", "SELECT p_partkey, p_brand FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 30")
query("hits", lambda s, d: parts(s, d).search("red widget", fields=[{"p_name^4": "exact"}], highlight=True, select=["p_name"]).hit_frame().select(F.col("_id").alias("id"), F.col("_index").alias("model"), F.col("_score").alias("score"), F.col("_source.p_name").alias("name"), F.col("highlight")["p_name"][0].alias("mark")), "SELECT CAST(p_partkey AS VARCHAR) AS id, 'part' AS model, 4.0 AS score, p_name AS name, '<em>red widget</em>' AS mark FROM part WHERE p_name = 'red widget'")


def metadata(spark: SparkSession, sf: str) -> list[tuple]:
    page = parts(spark, sf).search("*", where={"p_type": "SMALL"}, order="id", page=2, per_page=7, padding=1).results()
    total = page.response["hits"]["total"]["value"]
    return [(page.current_page, page.per_page, page.padding, page.offset_value, page.size, total, page.total_pages, page.first_page, page.last_page, page.out_of_range, page.entry_name, page[0]["p_partkey"])]


rows_query("page_metadata", metadata, "page int, per_page int, padding int, start int, size int, total long, pages int, first boolean, last boolean, outside boolean, entry string, key long", "SELECT 2 AS page, 7 AS per_page, 1 AS padding, 8 AS start, 7 AS size, count(*) AS total, CAST(ceil(count(*) / 7.0) AS INT) AS pages, false AS first, false AS last, false AS outside, 'part' AS entry, (SELECT p_partkey FROM part WHERE p_type = 'SMALL' ORDER BY 1 LIMIT 1 OFFSET 8) AS key FROM part WHERE p_type = 'SMALL'")
rows_query("exact_count", lambda s, d: [(parts(s, d).search("widget", fields=["p_name"], limit=3, **EXACT).count(), len(parts(s, d).search("widget", fields=["p_name"], limit=3, **EXACT)))], "n long, size int", f"SELECT count(*) AS n, 3 AS size {WIDGETS}")
rows_query("total_omitted", lambda s, d: [("total" in parts(s, d).search("*", limit=3, countless=True).results().response["hits"], parts(s, d).search("*", limit=3, countless=True, total_entries=5).results().total_count)], "known boolean, total long", "SELECT false AS known, CAST(5 AS BIGINT) AS total")
rows_query("scope_results", lambda s, d: (lambda page: [(r["o_orderkey"], True) for r in page] + [(m["id"], False) for m in page.missing_records])(orders(s, d).search("*", order={"o_totalprice": "desc"}, limit=60, scope_results=lambda df: df.where("o_orderstatus = 'F'")).results()), "o_orderkey long, kept boolean", "SELECT o_orderkey, o_orderstatus = 'F' AS kept FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 60")
rows_query("preloaded", lambda s, d: [(r["o_orderkey"], len(r["lines"])) for r in orders(s, d).search("*", order="id", limit=40, includes={"lines": (s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber"), "l_orderkey")}).results()], "o_orderkey long, lines int", "SELECT o_orderkey, count(l_orderkey) AS lines FROM (SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 40) LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")


query("loaded_as_hits", lambda s, d: parts(s, d).search("*", where={"p_size": 2}, boost_by=["p_size"], load=False).hit_frame().select("_source.p_partkey", F.col("_score").alias("score")), "SELECT p_partkey, ln(4) AS score FROM part WHERE p_size = 2")
rows_query("model_fields", lambda s, d: [(m.name, ",".join(m.text_fields()), m.column_type(m.pk)) for m in (parts(s, d), documents(s, d), events(s, d))], "model string, fields string, pk string", "SELECT * FROM (VALUES ('part', 'p_name,p_type,p_brand', 'bigint'), ('documents', 'text', 'bigint'), ('events', '{}', 'bigint')) AS v(model, fields, pk)".format("event_type"))


def heard(spark: SparkSession, sf: str) -> list[tuple]:
    """What listeners are told of a search, a count and its facets."""
    events_: list[tuple] = []
    listener = lambda event, ms: events_.append((len(events_), event, ms >= 0))
    listeners.append(listener)
    try:
        rel = parts(spark, sf).search("*", where={"p_size": 2}, aggs=["p_type"], limit=2)
        rel.results(), rel.count(), rel.results().aggs
    finally:
        listeners.remove(listener)
    return events_


rows_query("listeners", heard, "place int, event string, timed boolean", "SELECT * FROM (VALUES (0, 'search', true), (1, 'count', true), (2, 'aggregations', true)) AS v(place, event, timed)")


def nullable(spark: SparkSession, sf: str) -> SearchModel:
    df = spark.read.parquet(f"{sf}/part.parquet").withColumn("shelf", F.when(F.col("p_size") % 4 != 0, F.col("p_size") % 4))
    return SearchModel(df, pk="p_partkey", name="shelves")


def walked(order) -> Callable[[SparkSession, str], DataFrame]:
    """All rows in the order of a keyset's pages."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        rel = nullable(spark, sf).search("*", order=order, keyset=True, limit=700, select=["p_partkey"])
        return rel.walk().select(F.col("__place").alias("place"), "p_partkey")

    return run


_SHELF = "SELECT row_number() OVER (ORDER BY {0}, p_partkey) - 1 AS place, p_partkey FROM (SELECT p_partkey, CASE WHEN p_size % 4 <> 0 THEN p_size % 4 END AS shelf FROM part)"
query("keyset_of_nulls", walked(["shelf"]), _SHELF.format("shelf ASC NULLS LAST"))
query("keyset_of_nulls_down", walked([{"shelf": "desc"}]), _SHELF.format("shelf DESC NULLS FIRST"))


def sources(spark: SparkSession, sf: str, select) -> list[tuple]:
    inner = F.struct(F.col("p_size").cast("int").alias("size"), F.struct("p_type", "p_brand").alias("kind"))
    df = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_name", inner.alias("meta"))
    page = SearchModel(df, pk="p_partkey").search("*", order="id", limit=25, select=select).results()
    return [(int(h["_id"]), json.dumps(h["_source"])) for h in page.hits]


_FIRST = "FROM part ORDER BY p_partkey LIMIT 25"
rows_query("source_includes", lambda s, d: sources(s, d, ["p_name", "meta.kind.*"]), "p_partkey long, source string", f"SELECT p_partkey, '{{\"p_name\": \"' || p_name || '\", \"meta\": {{\"kind\": {{\"p_type\": \"' || p_type || '\", \"p_brand\": \"' || p_brand || '\"}}}}}}' AS source {_FIRST}")
rows_query("source_excludes", lambda s, d: sources(s, d, {"includes": ["meta"], "excludes": ["meta.kind.*"]}), "p_partkey long, source string", f"SELECT p_partkey, '{{\"meta\": {{\"size\": ' || p_size || ', \"kind\": {{}}}}}}' AS source {_FIRST}")


# -- groups and highlights

query("group_best_score", lambda s, d: aggregations.best_with_group_score(parts(s, d).search("*", boost_by=["p_size"]).matched, ["p_brand"], [F.desc("p_retailprice"), F.asc("p_partkey")]).select("p_brand", "p_partkey", F.round("group_score", 6).alias("group_score")), "SELECT p_brand, p_partkey, round(max(ln(2 + p_size)) OVER (PARTITION BY p_brand), 6) AS group_score FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) = 1")


def marks(name: str, sql: str, term: str, searched: list, columns: dict[str, str], **options) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rel = parts(spark, sf).search(term, fields=searched, highlight=options or True, **EXACT)
        return rel.highlighted(rel.rows).select("p_partkey", *(F.col(c).alias(n) for n, c in columns.items()))

    query(name, run, sql)


marks("highlight_whole_field", "SELECT p_partkey, '<em>' || p_name || '</em>' AS marked FROM part WHERE p_name = 'red widget'", "red widget", [{"p_name": "exact"}], {"marked": "highlighted_p_name"})
marks("highlight_per_field", "SELECT p_partkey, CASE WHEN contains(p_name, 'small') THEN replace(p_name, 'small', '<b>small</b>') END AS name, CASE WHEN p_type = 'SMALL' THEN '<i>SMALL</i>' END AS kind FROM part WHERE p_type = 'SMALL' OR list_contains(string_split(p_name, ' '), 'small')", "small", ["p_name", "p_type"], {"name": "highlighted_p_name", "kind": "highlighted_p_type"}, fields={"p_name": {"tag": "<b>"}, "p_type": {"tag": "<i>"}})
query("highlight_chosen_field", lambda s, d: s.createDataFrame([(r["p_partkey"], ",".join(sorted(h))) for r, h in parts(s, d).search("small", fields=["p_name", "p_type"], highlight={"fields": ["p_type"]}, where={"p_size": 3}, **EXACT).results().with_highlights(multiple=True)], "p_partkey long, fields string"), "SELECT p_partkey, CASE WHEN p_type = 'SMALL' THEN 'p_type' ELSE '' END AS fields FROM part WHERE p_size = 3 AND (p_type = 'SMALL' OR list_contains(string_split(p_name, ' '), 'small'))")
marks("highlight_mixed_modes", "SELECT p_partkey, CASE WHEN starts_with(p_name, 'small b') THEN '<em>' || p_name || '</em>' ELSE NULL END AS marked FROM part WHERE starts_with(p_name, 'small b')", "small b", [{"p_name": "text_start"}, {"p_name": "word"}], {"marked": "highlighted_p_name"})
marks("highlight_words_or_whole", "SELECT p_partkey, CASE WHEN p_name = 'small' THEN '<em>small</em>' ELSE replace(p_name, 'small', '<em>small</em>') END AS marked FROM part WHERE list_contains(string_split(p_name, ' '), 'small')", "small", [{"p_name": "exact"}, {"p_name": "word"}], {"marked": "highlighted_p_name"})
_FRAGMENT = "right(split_part(p_name, ' ', 1), 1) || ' <em>widget</em>'"
query("highlight_fragments", lambda s, d: parts(s, d).search("widget", fields=["p_name"], highlight={"fragment_size": 8, "number_of_fragments": 2}, **EXACT).hit_frame().select("_source.p_partkey", F.explode(F.col("highlight")["p_name"]).alias("marked")), f"SELECT p_partkey, {_FRAGMENT} AS marked {WIDGETS}")


def tagged(spark: SparkSession, sf: str) -> DataFrame:
    """Fragments of texts that hold the tag themselves."""
    df = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.concat(F.lit("<em>x</em> "), "p_name").alias("p_name"))
    found = SearchModel(df, pk="p_partkey", name="tagged").search("widget", highlight={"fragment_size": 8}, **EXACT).hit_frame()
    return found.select("_source.p_partkey", F.explode(F.col("highlight")["p_name"]).alias("marked"))


query("highlight_fragments_tagged", tagged, f"SELECT p_partkey, {_FRAGMENT} AS marked {WIDGETS}")
query("highlight_ansi", lambda s, d: (lambda rel: rel.rows.select("p_partkey", ansi(F.col("p_name"), rel._node(rel.fields_[0], rel.spelling)).alias("marked")))(parts(s, d).search("widget", fields=["p_name"], **EXACT)), f"SELECT p_partkey, replace(p_name, 'widget', chr(27) || '[1mwidget' || chr(27) || '[0m') AS marked {WIDGETS}")


# -- streams


def streamed_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Terms of an index that a stream of documents has been appended to."""
    top = session_folder(spark, "stream")
    # as a pattern, since a stream takes no path of a single file; the table may be a file or a folder of files
    rows = spark.readStream.schema("doc_id long, text string").parquet(f"{sf}/documents.parque[t]")
    index_stream(rows, "doc_id", ["text"], f"{top}/index", f"{top}/checkpoint").awaitTermination()
    held = latest_postings(spark.read.parquet(f"{top}/index")).where("term like 'licens%'")
    return held.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").cast("long").alias("cf"))


query("stream_index", streamed_terms, TOKENS + "SELECT w AS term, count(DISTINCT doc_id) AS df, CAST(count(*) AS BIGINT) AS cf FROM pos WHERE w LIKE 'licens%' GROUP BY 1")


# -- refusals

REFUSED: list[tuple[str, type[Exception], Callable[[SparkSession, str], object]]] = [
    ("max_expansions", UnsupportedError, lambda s, d: parts(s, d).search("x", misspellings={"max_expansions": 3}).count()),
    ("transpositions", UnsupportedError, lambda s, d: parts(s, d).search("x", misspellings={"transpositions": True}).count()),
    ("fuzzy wildcard", UnsupportedError, lambda s, d: parts(s, d).search("x", match="word_start", misspellings={"edit_distance": 1}).count()),
    ("fuzzy whole field", UnsupportedError, lambda s, d: parts(s, d).search("x", match="text_middle", misspellings=True).count()),
    ("stemming", UnsupportedError, lambda s, d: SearchModel(parts(s, d).df, pk="p_partkey", stem=True)),
    ("stemmed conversions", UnsupportedError, lambda s, d: SearchModel(parts(s, d).df, pk="p_partkey", stem_conversions=True)),
    ("date math", UnsupportedError, lambda s, d: orders(s, d).search("*", aggs={"o_orderdate": {"date_ranges": [{"from": "now-1d"}]}}).agg_frames()),
    ("date patterns", UnsupportedError, lambda s, d: orders(s, d).search("*", aggs={"o_orderdate": {"date_histogram": {"interval": "1d", "format": "yyyy-MM"}}}).agg_frames()),
    ("terms partitions", UnsupportedError, lambda s, d: parts(s, d).search("*", aggs={"p_size": {"include": {"partition": 0}}}).agg_frames()),
    ("recency on JSON", UnsupportedError, lambda s, d: events(s, d).search("*", boost_by_recency={"props.k": {"scale": "1d"}}).matched),
    ("facets of JSON", UnsupportedError, lambda s, d: events(s, d).search("*", aggs=["props.k"]).agg_frames()),
    ("unknown option", InvalidQueryError, lambda s, d: parts(s, d).search("*", typo=1)),
    ("unknown field", MissingFieldError, lambda s, d: parts(s, d).search("*", where={"none": 1}).rows),
    ("unknown filter", InvalidQueryError, lambda s, d: parts(s, d).search("*", where={"p_size": {"odd": 1}}).rows),
    ("tinql on whole fields", InvalidQueryError, lambda s, d: parts(s, d).search("x", match="exact", tinql="y").rows),
    ("keyset with a page", InvalidQueryError, lambda s, d: parts(s, d).search("*", keyset=True, page=2).to_df()),
    ("cursor of another order", InvalidQueryError, lambda s, d: parts(s, d).search("*", keyset=True, after="x").to_df()),
    ("extended past hard", InvalidQueryError, lambda s, d: orders(s, d).search("*", aggs={"o_orderdate": {"date_histogram": {"interval": "1d", "hard_bounds": {"min": "1995-01-02"}, "extended_bounds": {"min": "1995-01-01"}}}}).agg_frames()),
    ("bare number as interval", InvalidQueryError, lambda s, d: orders(s, d).search("*", boost_by_recency={"o_orderdate": {"scale": 30}}).matched),
    ("unknown highlight option", InvalidQueryError, lambda s, d: parts(s, d).search("x", highlight={"size": 3}).results()),
    ("highlight of an unknown field", MissingFieldError, lambda s, d: parts(s, d).search("x", highlight={"fields": ["none"]}).results()),
    ("span without words", InvalidQueryError, lambda s, d: documents(s, d).search(tinql={"near": [], "distance": 1}).rows),
]


def refusals(spark: SparkSession, sf: str) -> list[tuple]:
    out = []
    for name, error, attempt in REFUSED:
        try:
            attempt(spark, sf)
            out.append((name, "passed"))
        except (InvalidQueryError, MissingFieldError, UnsupportedError) as e:
            out.append((name, type(e).__name__ if type(e) is error else f"{type(e).__name__}, not {error.__name__}"))
    return out


rows_query("refusals", refusals, "what string, error string", "SELECT * FROM (VALUES " + ", ".join(f"('{name}', '{error.__name__}')" for name, error, _ in REFUSED) + ") AS v(what, error)")
