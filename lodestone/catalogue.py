"""The search engine's registered queries, each with the SQL that must give the same rows in DuckDB."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.analysis import SPELLED, TOKEN_RE
from .operators import aggregations, reranking
from .operators.filters import Between
from .plans.index import fsck
from .plans.relation import Relation
from .sources.model import SearchModel, parquet_model

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, make: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = make
    if sql is not None:
        ORACLE_SQL[name] = sql


def plain_documents(spark: SparkSession, sf: str) -> SearchModel:
    """Documents without an index: texts are tokenised as they are searched."""
    return parquet_model(spark, f"{sf}/documents.parquet", pk="doc_id", name="documents", searchable=("text",))


def documents(spark: SparkSession, sf: str) -> SearchModel:
    """Documents with the index of their text, built at the first search of a session."""
    return plain_documents(spark, sf).with_index(f"{sf}/documents.parquet")


def parts(spark: SparkSession, sf: str) -> SearchModel:
    return parquet_model(spark, f"{sf}/part.parquet", pk="p_partkey", name="part", searchable=("p_name", "p_type", "p_brand"))


def orders(spark: SparkSession, sf: str) -> SearchModel:
    return parquet_model(spark, f"{sf}/orders.parquet", pk="o_orderkey", name="orders")


def events(spark: SparkSession, sf: str) -> SearchModel:
    return parquet_model(spark, f"{sf}/events.parquet", pk="event_id", name="events", json=("props",))


def customers(spark: SparkSession, sf: str) -> SearchModel:
    """Customers with the distinct priorities and years of their orders as arrays, and a stored level with labels."""
    made = spark.read.parquet(f"{sf}/orders.parquet").groupBy("o_custkey").agg(
        F.sort_array(F.collect_set("o_orderpriority")).alias("priorities"),
        F.sort_array(F.collect_set(F.floor(F.col("o_totalprice") / 50000).cast("int"))).alias("bands"),
    )
    df = spark.read.parquet(f"{sf}/customer.parquet").join(made, F.col("c_custkey") == F.col("o_custkey"), "left").drop("o_custkey")
    df = df.withColumn("level", (F.col("c_nationkey") % 4).cast("int"))
    return SearchModel(df, pk="c_custkey", name="customer", enums={"level": {"low": 0, "mid": 1, "high": 2}})


CUSTOMERS = """WITH made AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) priorities, list_sort(list(DISTINCT CAST(floor(o_totalprice/50000) AS INT))) bands FROM orders GROUP BY 1),
c AS (SELECT customer.*, priorities, bands, c_nationkey % 4 AS level FROM customer LEFT JOIN made ON c_custkey = o_custkey) """


# -- words in documents: the same folding and tokens in SQL

_FOLDED = "strip_accents(lower(text))"
for _letter, _spelled in SPELLED.items():
    _FOLDED = f"replace({_FOLDED}, '{_letter}', '{_spelled}')"
TOKENS = f"""WITH tok AS (SELECT doc_id, lang, source, n_chars, text, regexp_extract_all({_FOLDED}, '{TOKEN_RE.replace("'", "''")}') AS t FROM documents),
pos AS (SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) AS p FROM tok), len AS (SELECT doc_id, len(t) AS n FROM tok) """


def found(relation: Callable[[SparkSession, str], Relation], *columns: str) -> Callable[[SparkSession, str], DataFrame]:
    def make(spark: SparkSession, sf: str) -> DataFrame:
        rel = relation(spark, sf)
        return rel.rows.select(rel.model.pk, *columns)

    return make


def doc_query(name: str, sql: str, term: str = "*", make: Callable[[SparkSession, str], SearchModel] = documents, **options) -> None:
    query(name, found(lambda s, d: make(s, d).search(term, **options)), TOKENS + sql)


def part_query(name: str, where: str, term: str = "*", **options) -> None:
    query(name, found(lambda s, d: parts(s, d).search(term, **options)), f"SELECT p_partkey FROM part WHERE {where}")


PART_WORDS = "regexp_extract_all(lower(p_name), '[a-z0-9]+')"

query("match_all", found(lambda s, d: parts(s, d).search("*")), "SELECT p_partkey FROM part")
EXACT = {"misspellings": False}
doc_query("word_and", "SELECT doc_id FROM tok WHERE list_contains(t, 'licensed') AND list_contains(t, 'under')", "Licensed UNDER", **EXACT)
doc_query("word_or", "SELECT doc_id FROM tok WHERE list_contains(t, 'thintion') OR list_contains(t, 'estion')", "thintion estion", operator="or", **EXACT)
doc_query("accent_fold", "SELECT doc_id FROM tok WHERE list_contains(t, 'ement')", "ément", **EXACT)
doc_query("phrase", "SELECT DISTINCT a.doc_id FROM pos a JOIN pos b ON a.doc_id = b.doc_id AND b.p = a.p + 1 WHERE a.w = 'licensed' AND b.w = 'under'", "licensed under", match="phrase")
doc_query("word_start", "SELECT doc_id FROM tok WHERE len(list_filter(t, lambda x: starts_with(x, 'achkeit'))) > 0", "achkeit", match="word_start")
doc_query("word_middle", "SELECT doc_id FROM tok WHERE len(list_filter(t, lambda x: contains(x, 'uequ'))) > 0", "uequ", match="word_middle")
doc_query("word_end", "SELECT doc_id FROM tok WHERE len(list_filter(t, lambda x: suffix(x, 'censed'))) > 0", "censed", match="word_end")
doc_query("exclude_phrase", "SELECT doc_id FROM tok WHERE list_contains(t, 'licensed') AND doc_id NOT IN (SELECT a.doc_id FROM pos a JOIN pos b ON a.doc_id = b.doc_id AND b.p = a.p + 1 WHERE a.w = 'gnu' AND b.w = 'general')", "licensed", exclude=["GNU general"], **EXACT)
PHRASE = "SELECT DISTINCT a.doc_id FROM pos a JOIN pos b ON a.doc_id = b.doc_id AND b.p = a.p + 1 WHERE a.w = 'licensed' AND b.w = 'under'"
doc_query("phrase_inline", PHRASE, "licensed under", match="phrase", make=plain_documents)
doc_query("word_and_inline", "SELECT doc_id FROM tok WHERE list_contains(t, 'licensed') AND list_contains(t, 'under')", "Licensed UNDER", make=plain_documents, **EXACT)
doc_query("word_start_inline", "SELECT doc_id FROM tok WHERE len(list_filter(t, lambda x: starts_with(x, 'achkeit'))) > 0", "achkeit", match="word_start", make=plain_documents)
part_query("exact", "p_name = 'red widget'", "red widget", match="exact", fields=["p_name"])
part_query("text_start", "starts_with(lower(p_name), 'red w')", "Red W", match="text_start", fields=["p_name"])
part_query("text_middle", "contains(lower(p_name), 'ed wi')", "ED wi", match="text_middle", fields=["p_name"])
part_query("text_end", "suffix(lower(p_name), 'dget')", "dget", match="text_end", fields=["p_name"])
part_query("fuzzy_1", f"len(list_filter({PART_WORDS}, lambda x: starts_with(x, 'w') AND levenshtein(x, 'widgt') <= 1)) > 0", "widgt", fields=["p_name"])
part_query("fuzzy_2_prefix0", f"len(list_filter({PART_WORDS}, lambda x: levenshtein(x, 'idgt') <= 2)) > 0", "idgt", fields=["p_name"], misspellings={"edit_distance": 2, "prefix_length": 0})
part_query("fuzzy_below_kept_exact", f"list_contains({PART_WORDS}, 'widget')", "widget", fields=["p_name"], misspellings={"below": 2})
part_query("fuzzy_below_widened", f"len(list_filter({PART_WORDS}, lambda x: starts_with(x, 'w') AND levenshtein(x, 'widgt') <= 1)) > 0", "widgt", fields=["p_name"], misspellings={"below": 2})
part_query(
    "fuzzy_per_field",
    f"len(list_filter({PART_WORDS}, lambda x: starts_with(x, 'w') AND levenshtein(x, 'widgt') <= 1)) > 0 OR list_contains(regexp_extract_all(lower(p_type), '[a-z0-9]+'), 'widgt')",
    "widgt", fields=["p_name", "p_type"], misspellings={"fields": ["p_name"]},
)
part_query("multi_field_or", "list_contains(regexp_extract_all(lower(p_name), '[a-z0-9]+'), 'small') OR list_contains(regexp_extract_all(lower(p_type), '[a-z0-9]+'), 'small')", "small", fields=["p_name", "p_type"], **EXACT)
part_query("exclude_multi_field", "list_contains(regexp_extract_all(lower(p_name), '[a-z0-9]+'), 'widget') AND NOT list_contains(regexp_extract_all(lower(p_type), '[a-z0-9]+'), 'small') AND NOT list_contains(regexp_extract_all(lower(p_name), '[a-z0-9]+'), 'small')", "widget", fields=["p_name", "p_type"], exclude="small", **EXACT)
part_query("mixed_modes", "p_name = 'small' OR list_contains(regexp_extract_all(lower(p_type), '[a-z0-9]+'), 'small') OR starts_with(lower(p_name), 'small')", "small", fields=[{"p_name": "exact"}, {"p_type": "word"}, {"p_name": "text_start"}], **EXACT)


# -- span queries

PAIR = "SELECT DISTINCT a.doc_id FROM pos a JOIN pos b ON a.doc_id = b.doc_id WHERE a.w = '{0}' AND b.w = '{1}' AND {2}"
GNU = {"near": ["licensed", "license"], "distance": 8}
#: Spans of "licensed" and "license" at most eight words apart, whichever comes first.
OUTER = "o AS (SELECT a.doc_id, least(a.p, b.p) s, greatest(a.p, b.p) e FROM pos a JOIN pos b ON a.doc_id = b.doc_id AND a.w = 'licensed' AND b.w = 'license' AND abs(a.p - b.p) BETWEEN 1 AND 9), "
INNER = "i AS (SELECT doc_id, p s, p e FROM pos WHERE w = 'general') "


def tinql_query(name: str, expression, sql: str) -> None:
    doc_query(f"tinql_{name}", sql, tinql=expression)


tinql_query("term", "licensed", "SELECT doc_id FROM tok WHERE list_contains(t, 'licensed')")
tinql_query("near", {"near": ["the", "licensed"], "distance": 1}, PAIR.format("the", "licensed", "abs(a.p - b.p) BETWEEN 1 AND 2"))
doc_query("tinql_near_inline", PAIR.format("the", "licensed", "abs(a.p - b.p) BETWEEN 1 AND 2"), tinql={"near": ["the", "licensed"], "distance": 1}, make=plain_documents)
tinql_query("then", {"then": ["licensed", "the"], "distance": 1}, PAIR.format("licensed", "the", "b.p - a.p BETWEEN 1 AND 2"))
tinql_query("within", {"within": GNU, "words": 8}, f", {OUTER}x AS (SELECT 1) SELECT DISTINCT doc_id FROM o WHERE e - s + 1 <= 8")
tinql_query("phrase_gap", {"phrase": ["licensed", None, "the"]}, PAIR.format("licensed", "the", "b.p = a.p + 2 AND 1 = 1"))
tinql_query("phrase_alt", {"phrase": ["licensed", ["under", "by"]]}, "SELECT DISTINCT a.doc_id FROM pos a JOIN pos b ON a.doc_id = b.doc_id AND b.p = a.p + 1 WHERE a.w = 'licensed' AND b.w IN ('under', 'by')")
tinql_query("phrase_slop", {"phrase": "licensed the", "slop": 2}, PAIR.format("licensed", "the", "b.p - a.p BETWEEN 1 AND 3"))
tinql_query("and", {"and": ["thintion", "estion"]}, "SELECT doc_id FROM tok WHERE list_contains(t, 'thintion') AND list_contains(t, 'estion')")
tinql_query("or", {"or": ["thintion", "estion"]}, "SELECT doc_id FROM tok WHERE list_contains(t, 'thintion') OR list_contains(t, 'estion')")
tinql_query("and_not", {"and_not": ["thintion", "estion"]}, "SELECT doc_id FROM tok WHERE list_contains(t, 'thintion') AND NOT list_contains(t, 'estion')")
tinql_query("any_of", {"any_of": ["queque", {"phrase": "licensed under"}]}, "SELECT doc_id FROM tok WHERE list_contains(t, 'queque') UNION SELECT a.doc_id FROM pos a JOIN pos b ON a.doc_id = b.doc_id AND b.p = a.p + 1 WHERE a.w = 'licensed' AND b.w = 'under'")
tinql_query("all_of", {"all_of": ["licensed", "general", "public"]}, "SELECT doc_id FROM tok WHERE list_contains(t, 'licensed') AND list_contains(t, 'general') AND list_contains(t, 'public')")
MIN_MATCH = "SELECT doc_id FROM tok WHERE CAST(list_contains(t, 'thintion') AS INT) + CAST(list_contains(t, 'estion') AS INT) + CAST(list_contains(t, 'ortion') AS INT) >= 2"
tinql_query("at_least_count", {"at_least": ["thintion", "estion", "ortion"], "count": 2}, MIN_MATCH)
tinql_query("at_least_percent", {"at_least": ["thintion", "estion", "ortion"], "percent": 50}, MIN_MATCH)
tinql_query("wildcard", {"wildcard": "th?ntion"}, "SELECT doc_id FROM tok WHERE len(list_filter(t, lambda x: regexp_matches(x, '^th.ntion$'))) > 0")
tinql_query("matches", {"matches": "(?:th|o)r?intion"}, "SELECT doc_id FROM tok WHERE len(list_filter(t, lambda x: regexp_matches(x, '^(?:(?:th|o)r?intion)$'))) > 0")
tinql_query("range", {"range": ["licensa", "licensez"]}, "SELECT doc_id FROM tok WHERE len(list_filter(t, lambda x: x >= 'licensa' AND x <= 'licensez')) > 0")
tinql_query("fuzzy", {"fuzzy": "licensd", "distance": 1, "prefix": 2}, "SELECT doc_id FROM tok WHERE len(list_filter(t, lambda x: starts_with(x, 'li') AND levenshtein(x, 'licensd') <= 1)) > 0")
tinql_query("before", {"before": [GNU, "version"]}, f", {OUTER}v AS (SELECT doc_id, p FROM pos WHERE w = 'version') SELECT DISTINCT o.doc_id FROM o JOIN v ON o.doc_id = v.doc_id AND o.e < v.p")
tinql_query("after", {"after": ["version", GNU]}, f", {OUTER}v AS (SELECT doc_id, p FROM pos WHERE w = 'version') SELECT DISTINCT o.doc_id FROM o JOIN v ON o.doc_id = v.doc_id AND v.p > o.e")
for _name, _test in (("encloses", "o.s <= i.s AND i.e <= o.e"), ("overlapping", "o.s <= i.e AND i.s <= o.e")):
    tinql_query(_name, {_name: [GNU, "general"]}, f", {OUTER}{INNER}SELECT DISTINCT o.doc_id FROM o JOIN i ON o.doc_id = i.doc_id AND {_test}")
for _name, _test in (("not_encloses", "o.s <= i.s AND i.e <= o.e"), ("not_overlapping", "o.s <= i.e AND i.s <= o.e")):
    tinql_query(_name, {_name: [GNU, "general"]}, f", {OUTER}{INNER}SELECT DISTINCT doc_id FROM o WHERE NOT EXISTS (SELECT 1 FROM i WHERE o.doc_id = i.doc_id AND {_test})")
tinql_query("enclosed_by", {"enclosed_by": ["general", GNU]}, f", {OUTER}{INNER}SELECT DISTINCT i.doc_id FROM o JOIN i ON o.doc_id = i.doc_id AND o.s <= i.s AND i.e <= o.e")
tinql_query("not_enclosed_by", {"not_enclosed_by": ["the", GNU]}, f", {OUTER}i AS (SELECT doc_id, p s, p e FROM pos WHERE w = 'the') SELECT DISTINCT doc_id FROM i WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.doc_id = i.doc_id AND o.s <= i.s AND i.e <= o.e)")
for _name, _option, _test in (("in_first", {"words": 5}, "p <= 5"), ("in_last", {"words": 5}, "p > n - 5"), ("in_middle", {"percent": 50}, "p > n * 0.25 AND p <= n * 0.75"), ("in_words", {"from": 3, "to": 6}, "p BETWEEN 3 AND 6"), ("in_first_percent", {"percent": 10}, "p <= n * 0.1"), ("in_last_percent", {"percent": 10}, "p > n - n * 0.1")):
    tinql_query(_name, {_name.removesuffix("_percent"): "the", **_option}, f"SELECT DISTINCT doc_id FROM pos JOIN len USING (doc_id) WHERE w = 'the' AND {_test}")
tinql_query("boost", {"boost": {"or": ["queque", "licensed"]}, "factor": 3}, "SELECT doc_id FROM tok WHERE list_contains(t, 'queque') OR list_contains(t, 'licensed')")
tinql_query("all", {"all": True}, "SELECT doc_id FROM tok")
tinql_query("raw", {"raw": '(licensed NEAR/1 "the") AND NOT apache OR queque'}, "SELECT DISTINCT a.doc_id FROM pos a JOIN pos b ON a.doc_id = b.doc_id JOIN tok ON tok.doc_id = a.doc_id WHERE a.w = 'licensed' AND b.w = 'the' AND abs(a.p - b.p) BETWEEN 1 AND 2 AND NOT list_contains(t, 'apache') UNION SELECT doc_id FROM tok WHERE list_contains(t, 'queque')")
doc_query("term_and_tinql", "SELECT doc_id FROM tok WHERE list_contains(t, 'licensed') AND list_contains(t, 'apache')", "licensed", tinql="apache", **EXACT)


# -- scores

BM25 = """, s AS (SELECT count(*) n, avg(len(t)) m FROM tok),
tf AS (SELECT tok.doc_id, q.w, len(list_filter(t, lambda x: x = q.w)) f, len(t) l FROM tok, (SELECT unnest([{words}]) w) q),
df AS (SELECT w, sum(CAST(f > 0 AS INT)) d FROM tf GROUP BY 1),
sc AS (SELECT doc_id, sum(CASE WHEN {elide} THEN 0 ELSE ln(1 + (n - d + 0.5) / (d + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / m)) END) x, min(f) least, max(f) most FROM tf JOIN df USING (w), s GROUP BY 1) """


def scored(relation: Callable[[SparkSession, str], Relation], k: int | None = None) -> Callable[[SparkSession, str], DataFrame]:
    def make(spark: SparkSession, sf: str) -> DataFrame:
        rel = relation(spark, sf)
        df = rel.limit(k).to_df() if k else rel.matched
        return df.select(rel.model.pk, F.round("_score", 6).alias("score"))

    return make


def bm25_sql(words: str, rest: str, elide: str = "d * 1.0 / n >= 0.1") -> str:
    return TOKENS + BM25.format(words=words, elide=elide) + rest


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Ranked search of documents for all of two words."""
    return documents(spark, sf).search("licensed under", limit=10, misspellings=False).to_df().select("doc_id", "lang", F.round("_score", 6).alias("score"))


query("search_word_and", flagship, bm25_sql("'licensed', 'under'", "SELECT doc_id, lang, round(x, 6) AS score FROM sc JOIN documents USING (doc_id) WHERE least > 0 ORDER BY x DESC, doc_id LIMIT 10"))
query("bm25_topk", scored(lambda s, d: documents(s, d).search("thintion estion", operator="or", **EXACT), 20), bm25_sql("'thintion', 'estion'", "SELECT doc_id, round(x, 6) AS score FROM sc WHERE most > 0 ORDER BY x DESC, doc_id LIMIT 20"))
query("bm25_topk_inline", scored(lambda s, d: plain_documents(s, d).search("thintion estion", operator="or", **EXACT), 20), ORACLE_SQL["bm25_topk"])
query("bm25_fuzzy", scored(lambda s, d: documents(s, d).search("licensd", misspellings={"edit_distance": 1, "prefix_length": 3})), TOKENS + ", f AS (SELECT doc_id, len(list_filter(t, lambda x: starts_with(x, 'lic') AND levenshtein(x, 'licensd') <= 1)) AS f, len(t) AS l FROM tok), s AS (SELECT count(*) AS n, avg(l) AS m, count(*) FILTER (WHERE f > 0) AS d FROM f) SELECT doc_id, round(CASE WHEN d * 1.0 / n >= 0.1 THEN 0 ELSE ln(1 + (n - d + 0.5) / (d + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / m)) END, 6) AS score FROM f, s WHERE f > 0")
query("bm25_phrase", scored(lambda s, d: documents(s, d).search("licensed under", match="phrase", fields=["text^1"])), TOKENS + ", f AS (SELECT a.doc_id, count(*) AS f FROM pos a JOIN pos b ON a.doc_id = b.doc_id AND b.p = a.p + 1 WHERE a.w = 'licensed' AND b.w = 'under' GROUP BY 1), s AS (SELECT count(*) AS n, avg(n) AS m, (SELECT count(*) FROM f) AS d FROM len) SELECT doc_id, round(ln(1 + (s.n - d + 0.5) / (d + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len.n / m)), 6) AS score FROM f JOIN len USING (doc_id), s")
query("bm25_all", scored(lambda s, d: documents(s, d).search("licensed", **EXACT)), bm25_sql("'licensed'", "SELECT doc_id, round(x, 6) AS score FROM sc WHERE most > 0"))
query("bm25_dense_elision", scored(lambda s, d: documents(s, d).search("the licensed", **EXACT)), bm25_sql("'the', 'licensed'", "SELECT doc_id, round(x, 6) AS score FROM sc WHERE least > 0"))
query("field_boost", scored(lambda s, d: documents(s, d).search("the licensed", fields=["text^3"], **EXACT)), bm25_sql("'the', 'licensed'", "SELECT doc_id, round(3 * x, 6) AS score FROM sc WHERE least > 0", "false"))
query("weighted_exact", scored(lambda s, d: parts(s, d).search("red widget", fields=[{"p_name^12.5": "exact"}, {"p_name": "text_start"}])), "SELECT p_partkey, (CASE WHEN p_name = 'red widget' THEN 12.5 ELSE 0 END + 1.0) AS score FROM part WHERE starts_with(lower(p_name), 'red widget')")
query("tinql_boosted_score", scored(lambda s, d: documents(s, d).search(tinql={"or": [{"boost": "queque", "factor": 2}, {"boost": "licensed", "factor": 2}]})), bm25_sql("'queque', 'licensed'", "SELECT doc_id, round(2 * x, 6) AS score FROM sc WHERE most > 0", "false"))


def built_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Terms of the built index with the documents and the places that hold them."""
    index = documents(spark, sf).index
    sums = index.postings.where("term like 'licens%'").groupBy("term").agg(F.sum("tf").cast("long").alias("cf"))
    return index.dictionary.where("term like 'licens%'").join(sums, "term").select("term", "df", "cf")


query("index_dictionary", built_terms, TOKENS + "SELECT w AS term, count(DISTINCT doc_id) AS df, CAST(count(*) AS BIGINT) AS cf FROM pos WHERE w LIKE 'licens%' GROUP BY 1")
query("index_corpus", lambda s, d: documents(s, d).index.corpus.select("field", "n", F.round("mean", 6).alias("mean")), TOKENS + "SELECT 'text' AS field, count(*) AS n, round(avg(n), 6) AS mean FROM len")
query("index_rows", lambda s, d: documents(s, d).index.rows.groupBy(F.col("dl").cast("long").alias("dl")).agg(F.count("*").alias("n")), TOKENS + "SELECT n AS dl, count(*) AS n FROM len GROUP BY ALL".replace("n AS dl", "len.n AS dl"))
query("index_check", lambda s, d: fsck(documents(s, d).index), "SELECT 'text' AS field, '' AS problem, 0 AS n FROM region WHERE false")


# -- filters


def filter_query(name: str, make: Callable[[SparkSession, str], SearchModel], where: dict, sql: str) -> None:
    query(f"filter_{name}", found(lambda s, d: make(s, d).search("*", where=where)), sql)


def part_filter(name: str, where: dict, sql: str) -> None:
    filter_query(name, parts, where, f"SELECT p_partkey FROM part WHERE {sql}")


part_filter("eq", {"p_brand": "Brand#11"}, "p_brand = 'Brand#11'")
part_filter("in_null", {"p_size": [1, 5, None]}, "p_size IN (1, 5) OR p_size IS NULL")
part_filter("in_empty", {"p_size": []}, "false")
part_filter("not", {"p_brand": {"not": ["Brand#11", "Brand#12"]}}, "p_brand NOT IN ('Brand#11', 'Brand#12') OR p_brand IS NULL")
part_filter("compare", {"p_size": {"gt": 10, "lte": 20}}, "p_size > 10 AND p_size <= 20")
part_filter("range_excl", {"p_size": Between(10, 20, exclusive=True)}, "p_size >= 10 AND p_size < 20")
part_filter("range_open", {"p_retailprice": Between(None, 910.5)}, "p_retailprice <= 910.5")
part_filter("exists", {"p_size": {"exists": True}}, "p_size IS NOT NULL")
part_filter("like", {"p_name": {"like": "%d w_dget"}}, "p_name LIKE '%d w_dget'")
part_filter("ilike", {"p_name": {"ilike": "RED%"}}, "p_name ILIKE 'RED%'")
part_filter("prefix", {"p_name": {"prefix": "re"}}, "starts_with(p_name, 're')")
part_filter("regexp", {"p_brand": {"regexp": "#[[:digit:]]{2}$"}}, "regexp_matches(p_brand, '#[0-9]{2}$')")
part_filter("or_groups", {"_or": [{"p_size": 1}, {"_and": [{"p_size": 2}, {"p_brand": "Brand#1"}]}], "p_type": {"_not": "SMALL"}}, "(p_size = 1 OR (p_size = 2 AND p_brand = 'Brand#1')) AND (p_type <> 'SMALL' OR p_type IS NULL)")
part_filter("not_group", {"_not": {"p_size": {"lt": 40}, "p_brand": "Brand#1"}}, "NOT p_size < 40 AND p_brand <> 'Brand#1'")
part_filter("legacy_or", {"or": [[{"p_size": 1}, {"p_size": 2}], [{"p_type": "SMALL"}, {"p_type": "ECONOMY"}]]}, "p_size IN (1, 2) AND p_type IN ('SMALL', 'ECONOMY')")
part_filter("id_alias", {"id": {"lt": 50}}, "p_partkey < 50")
filter_query("enum", customers, {"level": ["low", "unheard"]}, CUSTOMERS + "SELECT c_custkey FROM c WHERE level = 0")
filter_query("enum_null", customers, {"level": None}, CUSTOMERS + "SELECT c_custkey FROM c WHERE level = 3")
filter_query("enum_range", customers, {"level": {"gte": "low"}}, CUSTOMERS + "SELECT c_custkey FROM c WHERE level IN (0, 1)")
filter_query("array_member", customers, {"priorities": "1-URGENT"}, CUSTOMERS + "SELECT c_custkey FROM c WHERE list_contains(priorities, '1-URGENT')")
filter_query("array_all", customers, {"priorities": {"all": ["1-URGENT", "2-HIGH"]}}, CUSTOMERS + "SELECT c_custkey FROM c WHERE list_contains(priorities, '1-URGENT') AND list_contains(priorities, '2-HIGH')")
filter_query("array_missing", customers, {"priorities": None}, CUSTOMERS + "SELECT c_custkey FROM c WHERE priorities IS NULL OR len(priorities) = 0")
filter_query("array_range", customers, {"bands": {"gt": 2, "lt": 5}}, CUSTOMERS + "SELECT c_custkey FROM c WHERE len(list_filter(bands, lambda x: x > 2 AND x < 5)) > 0")
filter_query("array_pattern", customers, {"priorities": {"prefix": "5"}}, CUSTOMERS + "SELECT c_custkey FROM c WHERE len(list_filter(priorities, lambda x: starts_with(x, '5'))) > 0")
filter_query("json_eq", events, {"props.k": 87}, "SELECT event_id FROM events WHERE CAST(props->>'$.k' AS DOUBLE) = 87")
filter_query("json_typed", events, {"props.k": "87"}, "SELECT event_id FROM events WHERE false")
filter_query("json_in", events, {"props.k": [1, 2, 3]}, "SELECT event_id FROM events WHERE CAST(props->>'$.k' AS INT) IN (1, 2, 3)")
filter_query("json_range", events, {"props.k": {"gt": 30, "lt": 40}}, "SELECT event_id FROM events WHERE CAST(props->>'$.k' AS DOUBLE) > 30 AND CAST(props->>'$.k' AS DOUBLE) < 40")
filter_query("json_exists", events, {"props.k": {"exists": True}, "props.none": None}, "SELECT event_id FROM events WHERE props->>'$.k' IS NOT NULL")
filter_query("json_not", events, {"props.k": {"not": 87}}, "SELECT event_id FROM events WHERE CAST(props->>'$.k' AS DOUBLE) <> 87 OR props->>'$.k' IS NULL")


# -- boosts

query("boost_by_default", scored(lambda s, d: parts(s, d).search("*", boost_by=["p_size"])), "SELECT p_partkey, round(ln(2 + p_size), 6) AS score FROM part")
query("boost_by_modifiers", scored(lambda s, d: parts(s, d).search("*", boost_by={"p_size": {"factor": 2, "modifier": "sqrt"}, "p_retailprice": {"modifier": "log1p", "boost_mode": "multiply"}})), "SELECT p_partkey, round(sqrt(2 * p_size) * log10(p_retailprice + 1), 6) AS score FROM part")
query("boost_missing", scored(lambda s, d: customers(s, d).search("*", boost_by={"bands": {"missing": 7, "modifier": "square"}})), CUSTOMERS + "SELECT c_custkey, CAST(coalesce(list_min(bands), 7) * coalesce(list_min(bands), 7) AS DOUBLE) AS score FROM c")
query("boost_where", scored(lambda s, d: parts(s, d).search("*", boost_where={"p_type": "SMALL", "p_brand": [{"value": "Brand#1", "factor": 5}, {"value": "Brand#2", "factor": 7}]})), "SELECT p_partkey, CAST(CASE WHEN p_type = 'SMALL' OR p_brand IN ('Brand#1', 'Brand#2') THEN CASE WHEN p_type = 'SMALL' THEN 1000 ELSE 0 END + CASE WHEN p_brand = 'Brand#1' THEN 5 WHEN p_brand = 'Brand#2' THEN 7 ELSE 0 END ELSE 1 END AS DOUBLE) AS score FROM part")
ORIGIN = dt.datetime(1998, 1, 1)
AWAY = "greatest(abs(epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1998-01-01')) - 86400000000, 0) / (30 * 86400000000.0)"
for _shape, _sql in (("gauss", f"pow(0.5, ({AWAY}) * ({AWAY}))"), ("exp", f"pow(0.5, {AWAY})"), ("linear", f"greatest(0, 1 - 0.5 * {AWAY})")):
    query(f"boost_recency_{_shape}", scored(lambda s, d, shape=_shape: orders(s, d).search("*", boost_by_recency={"o_orderdate": {"scale": "30d", "offset": "1 day", "origin": ORIGIN, "function": shape, "factor": 2}})), f"SELECT o_orderkey, round(2 * {_sql}, 6) AS score FROM orders")


def converted(spark: SparkSession, sf: str) -> SearchModel:
    df = spark.read.parquet(f"{sf}/part.parquet").withColumn("searched", F.concat(F.lit('{"Widget": '), F.col("p_size").cast("string"), F.lit(', "widget": 2}')))
    return SearchModel(df, pk="p_partkey", name="part", searchable=("p_name",), conversions_v1=("searched",))


query("conversions_v1", scored(lambda s, d: converted(s, d).search("widget", fields=["p_name^0"], **EXACT)), "SELECT p_partkey, CAST(p_size + 2 AS DOUBLE) AS score FROM part WHERE list_contains(regexp_extract_all(lower(p_name), '[a-z0-9]+'), 'widget')")
query("conversions_v2", scored(lambda s, d: converted(s, d).search("widget", fields=["p_name^0"], conversions_v1=False, conversions_v2={"field": "searched", "factor": 0.25}, **EXACT)), "SELECT p_partkey, CAST(0.5 AS DOUBLE) AS score FROM part WHERE list_contains(regexp_extract_all(lower(p_name), '[a-z0-9]+'), 'widget')")


# -- facets


def agg_query(name: str, make: Callable[[SparkSession, str], SearchModel], aggs, sql: str | None, columns: dict[str, str] | None = None, **options) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        _, facet, _ = next(iter(make(spark, sf).search("*", aggs=aggs, **options).agg_frames().values()))
        return facet.selectExpr(*(f"{v} AS {k}" for k, v in columns.items())) if columns else facet

    query(name, run, sql)


TERMS = {"key": "key", "doc_count": "doc_count"}
agg_query("terms", parts, ["p_brand"], "SELECT p_brand AS key, count(*) AS doc_count FROM part GROUP BY 1", TERMS)
agg_query("terms_limit_other", parts, {"p_brand": {"limit": 3}}, "WITH c AS (SELECT p_brand AS key, count(*) AS doc_count FROM part GROUP BY 1), t AS (SELECT * FROM c ORDER BY doc_count DESC, key LIMIT 3) SELECT key, doc_count, CAST((SELECT sum(doc_count) FROM c) - (SELECT sum(doc_count) FROM t) AS BIGINT) AS sum_other_doc_count FROM t")
agg_query("terms_order_key", parts, {"p_size": {"limit": 5, "order": {"_key": "desc"}}}, "SELECT p_size AS key, count(*) AS doc_count FROM part GROUP BY 1 ORDER BY 1 DESC LIMIT 5", TERMS)
agg_query("terms_zero", parts, {"p_brand": {"min_doc_count": 0}}, "SELECT p_brand AS key, count(*) FILTER (WHERE p_type = 'SMALL' AND p_size = 3) AS doc_count FROM part GROUP BY 1", TERMS, where={"p_type": "SMALL", "p_size": 3})
agg_query("terms_include_exclude", parts, {"p_brand": {"include": "^Brand#1", "exclude": ["Brand#11"]}}, "SELECT p_brand AS key, count(*) AS doc_count FROM part WHERE starts_with(p_brand, 'Brand#1') AND p_brand <> 'Brand#11' GROUP BY 1", TERMS)
agg_query("terms_missing", customers, {"priorities": {"missing": "none"}}, CUSTOMERS + "SELECT key, count(*) AS doc_count FROM (SELECT unnest(CASE WHEN priorities IS NULL OR len(priorities) = 0 THEN ['none'] ELSE priorities END) AS key FROM c) GROUP BY 1", TERMS)
agg_query("terms_array", customers, ["bands"], CUSTOMERS + "SELECT key, count(*) AS doc_count FROM (SELECT unnest(bands) AS key FROM c) GROUP BY 1", TERMS)
for _metric in ("avg", "min", "max", "sum"):
    agg_query(f"metric_{_metric}", orders, {"v": {_metric: {"field": "o_totalprice"}}}, f"SELECT round(CAST({_metric}(o_totalprice) AS DOUBLE), 2) AS value FROM orders", {"value": "round(value, 2)"})
agg_query("metric_array", customers, {"v": {"avg": {"field": "bands"}}}, CUSTOMERS + "SELECT round(avg(x), 6) AS value FROM (SELECT unnest(bands) AS x FROM c)", {"value": "round(value, 6)"})
agg_query("metric_cardinality", orders, {"v": {"cardinality": {"field": "o_custkey"}}}, "SELECT CAST(count(DISTINCT o_custkey) AS DOUBLE) AS value FROM orders")
agg_query("ranges", parts, {"p_retailprice": {"ranges": [{"to": 905}, {"from": 902, "to": 1000.5}, {"from": 1e6}]}}, "SELECT '*-905.0' AS key, count(*) FILTER (WHERE p_retailprice < 905) AS doc_count FROM part UNION ALL SELECT '902.0-1000.5', count(*) FILTER (WHERE p_retailprice >= 902 AND p_retailprice < 1000.5) FROM part UNION ALL SELECT '1000000.0-*', 0 FROM region WHERE r_regionkey = 0", TERMS)
agg_query("ranges_array", customers, {"bands": {"ranges": [{"from": 1, "to": 3}, {"to": 2}]}}, CUSTOMERS + "SELECT '*-2.0' AS key, count(*) FILTER (WHERE len(list_filter(bands, lambda x: x < 2)) > 0) AS doc_count FROM c UNION ALL SELECT '1.0-3.0', count(*) FILTER (WHERE len(list_filter(bands, lambda x: x >= 1 AND x < 3)) > 0) FROM c", TERMS)
agg_query("date_ranges", orders, {"o_orderdate": {"date_ranges": [{"to": "1995-01-01", "key": "old"}, {"from": "1995-01-01", "to": "1997-01-01", "key": "mid"}]}}, "SELECT 'old' AS key, count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1995-01-01') AS doc_count FROM orders UNION ALL SELECT 'mid', count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1997-01-01') FROM orders", TERMS)
agg_query("histogram", orders, {"o_totalprice": {"histogram": {"interval": 50000}}}, "WITH c AS (SELECT CAST(floor(o_totalprice / 50000) AS BIGINT) AS a, count(*) AS n FROM orders GROUP BY 1) SELECT CAST(g * 50000 AS DOUBLE) AS key, coalesce(n, 0) AS doc_count FROM (SELECT unnest(generate_series((SELECT min(a) FROM c), (SELECT max(a) FROM c))) AS g) LEFT JOIN c ON a = g")
agg_query("histogram_extended", parts, {"p_size": {"histogram": {"interval": 10, "extended_bounds": {"min": -20, "max": 75}}}}, "WITH c AS (SELECT CAST(floor(p_size / 10.0) AS BIGINT) AS a, count(*) AS n FROM part GROUP BY 1) SELECT CAST(g * 10 AS DOUBLE) AS key, coalesce(n, 0) AS doc_count FROM (SELECT unnest(generate_series(-2, 7)) AS g) LEFT JOIN c ON a = g")
agg_query("histogram_hard_offset", parts, {"p_size": {"histogram": {"interval": 10, "offset": 5, "hard_bounds": [0, 20], "min_doc_count": 1, "order": {"_count": "desc"}}}}, "SELECT CAST(a * 10 + 5 AS DOUBLE) AS key, count(*) AS doc_count FROM (SELECT CAST(floor((p_size - 5) / 10.0) AS BIGINT) AS a FROM part) WHERE a * 10 BETWEEN 0 AND 20 GROUP BY a")
for _unit, _every in (("month", "1 MONTH"), ("week", "7 DAY"), ("quarter", "3 MONTH"), ("year", "1 YEAR")):
    agg_query(f"date_hist_{_unit}", orders, {"o_orderdate": {"date_histogram": {"interval": _unit}}}, f"WITH c AS (SELECT date_trunc('{_unit}', o_orderdate)::TIMESTAMP AS a, count(*) AS n FROM orders GROUP BY 1) SELECT epoch_ms(g) AS key, coalesce(n, 0) AS doc_count FROM (SELECT unnest(generate_series((SELECT min(a) FROM c), (SELECT max(a) FROM c), INTERVAL {_every})) AS g) LEFT JOIN c ON a = g", {"key": "unix_millis(key)", "doc_count": "doc_count"})
agg_query("date_hist_day", events, {"ts": {"date_histogram": {"interval": "1d", "min_doc_count": 1}}}, "SELECT epoch_ms(date_trunc('day', ts)::TIMESTAMP) AS key, count(*) AS doc_count FROM events GROUP BY 1", {"key": "unix_millis(key)", "doc_count": "doc_count"})
agg_query("date_hist_fixed_90m", events, {"ts": {"date_histogram": {"fixed_interval": "90m", "min_doc_count": 1}}}, "SELECT CAST(floor(epoch_us(ts) / 5400000000.0) AS BIGINT) * 5400000 AS key, count(*) AS doc_count FROM events GROUP BY 1", {"key": "unix_millis(key)", "doc_count": "doc_count"})
agg_query("date_hist_offset", events, {"ts": {"date_histogram": {"interval": "1d", "offset": "+6h", "min_doc_count": 1}}}, "SELECT epoch_ms((date_trunc('day', ts - INTERVAL 6 HOUR) + INTERVAL 6 HOUR)::TIMESTAMP) AS key, count(*) AS doc_count FROM events GROUP BY 1", {"key": "unix_millis(key)", "doc_count": "doc_count"})
NEW_YORK = "timezone('America/New_York', timezone('UTC', {0}))"
agg_query("date_hist_tz_new_york", orders, {"o_orderdate": {"date_histogram": {"interval": "1M", "time_zone": "America/New_York", "min_doc_count": 1}}}, f"WITH l AS (SELECT date_trunc('month', {NEW_YORK.format('o_orderdate')})::TIMESTAMP AS a, count(*) AS doc_count FROM orders GROUP BY 1), k AS (SELECT a, doc_count, timezone('UTC', timezone('America/New_York', a)) AS u FROM l) SELECT epoch_ms(u) AS key, strftime(a, '%Y-%m-%dT%H:%M:%S.000') || CASE WHEN date_diff('hour', a, u) = 4 THEN '-04:00' ELSE '-05:00' END AS key_as_string, doc_count FROM k", {"key": "unix_millis(key)", "key_as_string": "key_as_string", "doc_count": "doc_count"})
agg_query("date_hist_tz_fixed", orders, {"o_orderdate": {"date_histogram": {"interval": "1M", "time_zone": "-05:00", "min_doc_count": 1}}}, "SELECT epoch_ms((date_trunc('month', o_orderdate - INTERVAL 5 HOUR) + INTERVAL 5 HOUR)::TIMESTAMP) AS key, strftime(date_trunc('month', o_orderdate - INTERVAL 5 HOUR), '%Y-%m-%dT%H:%M:%S.000-05:00') AS key_as_string, count(*) AS doc_count FROM orders GROUP BY ALL", {"key": "unix_millis(key)", "key_as_string": "key_as_string", "doc_count": "doc_count"})
SMART = {"where": {"p_brand": "Brand#11", "p_type": "SMALL"}}
agg_query("smart_facet", parts, ["p_brand"], "SELECT p_brand AS key, count(*) AS doc_count FROM part WHERE p_type = 'SMALL' GROUP BY 1", TERMS, **SMART)
agg_query("smart_facet_own_where", parts, {"p_brand": {"where": {"p_size": {"lt": 25}}}}, "SELECT p_brand AS key, count(*) AS doc_count FROM part WHERE p_type = 'SMALL' AND p_brand = 'Brand#11' AND p_size < 25 GROUP BY 1", TERMS, **SMART)
agg_query("smart_facet_off", parts, ["p_brand"], "SELECT p_brand AS key, count(*) AS doc_count FROM part GROUP BY 1", TERMS, smart_aggs=False, **SMART)


# -- pages, fusion, recipes, highlights


def page_query(name: str, make: Callable[[SparkSession, str], SearchModel], columns: tuple[str, ...], sql: str, **options) -> None:
    query(name, lambda s, d: make(s, d).search("*", **options).to_df().select(*columns), sql)


page_query("order_multi", orders, ("o_orderkey", "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderpriority ASC NULLS LAST, o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 50", order=[{"o_orderpriority": "asc"}, {"o_totalprice": "desc"}], limit=50)
page_query("offset_page", orders, ("o_orderkey",), "SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20 OFFSET 43", order="o_totalprice", page=3, per_page=20, padding=3)
page_query("countless_probe", orders, ("o_orderkey",), "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 11", order={"o_totalprice": "desc"}, limit=10, countless=True)


def keyset_page2(spark: SparkSession, sf: str) -> DataFrame:
    first = orders(spark, sf).search("*", order=["o_orderpriority"], keyset=True, limit=25)
    return first.after(first.results().cursor).to_df().select("o_orderkey").limit(25)


query("keyset_page2", keyset_page2, "SELECT o_orderkey FROM orders ORDER BY o_orderpriority, o_orderkey LIMIT 25 OFFSET 25")


def fused(spark: SparkSession, sf: str) -> DataFrame:
    lists = [reranking.ranked(parts(spark, sf).search("*", order=[{k: "desc"}], limit=30).to_df(), "p_partkey", k) for k in ("p_retailprice", "p_size")]
    return reranking.rrf_frames(*lists, key="p_partkey").select("p_partkey", F.round("score", 8).alias("score"))


query("rrf", fused, "WITH a AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) r FROM part QUALIFY r <= 30), b AS (SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_partkey) r FROM part QUALIFY r <= 30) SELECT p_partkey, round(sum(1.0 / (60 + r)), 8) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1")


def collapsed(spark: SparkSession, sf: str) -> DataFrame:
    rel = parts(spark, sf).search("*", boost_by=["p_size"])
    return aggregations.best_of_group(rel.matched, ["p_brand"], [F.desc("_score"), F.asc("p_partkey")]).select("p_brand", "p_partkey")


query("collapse_best_of_group", collapsed, "SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY ln(2 + p_size) DESC, p_partkey) = 1")


query("top_per_group", lambda s, d: aggregations.best_of_group(parts(s, d).search("widget", fields=["p_name"], boost_by=["p_retailprice"], **EXACT).matched, ["p_brand"], [F.desc("p_retailprice"), F.asc("p_partkey")], 3).select("p_brand", "p_partkey"), "SELECT p_brand, p_partkey FROM part WHERE list_contains(regexp_extract_all(lower(p_name), '[a-z0-9]+'), 'widget') QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 3")
query("json_text_field", found(lambda s, d: events(s, d).search("87", fields=["props.k"], **EXACT)), "SELECT event_id FROM events WHERE props->>'$.k' = '87'")


def custom_rank(spark: SparkSession, sf: str) -> DataFrame:
    hook = lambda df: df.where("p_size > 5").withColumn("_score", F.when(F.col("p_type") == "SMALL", 2.0).otherwise(1.0) * F.ln(F.col("p_retailprice")))
    return parts(spark, sf).search("*", block=hook, limit=25).to_df().select("p_partkey", F.round("_score", 6).alias("score"))


query("custom_rank", custom_rank, "SELECT p_partkey, round((CASE WHEN p_type = 'SMALL' THEN 2.0 ELSE 1.0 END) * ln(p_retailprice), 6) AS score FROM part WHERE p_size > 5 ORDER BY (CASE WHEN p_type = 'SMALL' THEN 2.0 ELSE 1.0 END) * ln(p_retailprice) DESC, p_partkey LIMIT 25")


def highlight_query(name: str, sql: str, **options) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rel = parts(spark, sf).search("widget", fields=["p_name"], highlight=options or True, **EXACT)
        return rel.highlighted(rel.rows).select("p_partkey", F.col("highlighted_p_name").alias("marked"))

    query(name, run, sql)


WIDGETS = "FROM part WHERE regexp_matches(p_name, '\\bwidget\\b')"
highlight_query("highlight_full", f"SELECT p_partkey, regexp_replace(p_name, '\\bwidget\\b', '<em>widget</em>', 'g') AS marked {WIDGETS}")
highlight_query("highlight_tag", f"SELECT p_partkey, regexp_replace(p_name, '\\bwidget\\b', '<b class=\"x\">widget</b>', 'g') AS marked {WIDGETS}", tag='<b class="x">')


def highlight_html(spark: SparkSession, sf: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.concat(F.lit("<i> & "), "p_name").alias("p_name"))
    rel = SearchModel(df, pk="p_partkey", name="part").search("widget", highlight={"encoder": "html"}, **EXACT)
    return rel.highlighted(rel.rows).select("p_partkey", F.col("highlighted_p_name").alias("marked"))


query("highlight_html", highlight_html, f"SELECT p_partkey, '&lt;i&gt; &amp; ' || regexp_replace(p_name, '\\bwidget\\b', '<em>widget</em>', 'g') AS marked {WIDGETS}")


from . import catalogue_pages  # noqa: E402,F401  pages, facets as they are rendered, refusals: registers its queries here
