import duckdb
import pytest

import __spark_entry__ as entry
from lodestone import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Some of each family; the driver runs them all.
SOME = ["word_and", "fuzzy_1", "tinql_near", "tinql_not_encloses", "bm25_topk", "filter_json_range", "filter_array_range", "boost_recency_gauss", "terms_limit_other", "histogram_extended", "date_hist_month", "smart_facet_own_where", "keyset_page2", "rrf", "highlight_full"]


@pytest.fixture(scope="module")
def db(sf):
    found = duckdb.connect()
    for t in TABLES:
        found.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return found


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in frame.astype(object).where(frame.notna(), None).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", SOME)
def test_spark_agrees_with_sql(spark, sf, db, name):
    assert rows(catalogue.QUERIES[name](spark, sf).toPandas()) == rows(db.execute(catalogue.ORACLE_SQL[name]).df())


def test_entry_and_names(spark):
    assert entry.entry(spark).columns == ["doc_id", "lang", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(catalogue.ORACLE_SQL) > 120
