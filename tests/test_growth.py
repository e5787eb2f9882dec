"""Limits that small tables don't reach, with small limits or odd layouts in their place."""

from pyspark.sql import functions as F

from lodestone import catalogue
from lodestone.functions.jsonpath import json_leaves
from lodestone.functions.analysis import tokens
from lodestone.operators import tinql
from lodestone.plans import index, relation
from lodestone.sources.model import SearchModel


def test_json_walk_takes_more_rows_than_a_recursive_query(spark):
    df = spark.range(40).select("id", F.parse_json(F.lit('{"a": [[1, [2]], {"b": 3}, null, []]}')).alias("v"))
    spark.conf.set("spark.sql.cteRecursionRowLimit", "30")
    try:
        found = json_leaves(df, "id", "v", ["a"]).select("id", F.to_json("leaf").alias("x")).collect()
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    assert sorted(map(tuple, found)) == sorted((i, x) for i in range(40) for x in ("1", "2", '{"b":3}', "null"))


def test_stream_index_reads_a_table_of_several_files(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    one, several = (sorted(map(tuple, catalogue.QUERIES["stream_index"](spark, d).collect())) for d in (sf, str(tmp_path)))
    assert one and one == several


def test_hits_go_past_the_page(spark, monkeypatch):
    monkeypatch.setattr(relation, "DEFAULT_LIMIT", 3)
    df = spark.createDataFrame([(i, f"big red apple {i} tart", i % 4) for i in range(9)] + [(9, "pear", 1), (10, None, 1)], "id long, name string, n int")
    rel = SearchModel(df, pk="id", name="fruit").search("apple", fields=["name"], order={"n": "desc"}, highlight={"fragment_size": 9}, misspellings=False)
    found = [r.asDict(recursive=True) for r in rel.hit_frame().collect()]
    paged = rel.limit(100).results().hits
    assert len(paged) == 9 and found == [{"highlight": {}, **h} for h in paged]
    assert [(r["_id"], r["highlight"]) for r in rel.highlight(True).hit_frame().collect()] == [(h["_id"], h["highlight"]) for h in rel.highlight(True).limit(100).results().hits]
    plain = SearchModel(df, pk="id", name="fruit").search("*", select=["name"]).hit_frame().collect()
    assert len(plain) == 11 and plain[0]["_source"].asDict() == {"name": "big red apple 0 tart"} and plain[0]["highlight"] is None


def test_a_keyset_is_walked_at_once_as_by_its_cursors(spark):
    df = spark.createDataFrame([(i, i * 7 % 5 or None) for i in range(40)], "id long, shelf long").repartition(5)
    for order in (["shelf"], [{"shelf": "desc"}]):
        rel = SearchModel(df, pk="id", name="shelves").search("*", order=order, keyset=True, limit=7)
        page, want = rel.results(), []
        while True:
            want += [(len(want) // 7, len(want) + k, r["id"]) for k, r in enumerate(page)]
            if not page.has_next_page:
                break
            page = rel.after(page.next_cursor).results()
        assert sorted(map(tuple, rel.walk().select("__page", "__place", "id").collect())) == want
        later = rel.after(rel.results().next_cursor).walk().select("__place", "id").collect()
        assert sorted(map(tuple, later)) == [(place - 7, i) for _, place, i in want[7:]]


def test_an_index_reads_each_text_once_and_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "CUT_TOKENS", 4)
    texts = [None, "", "...", "b a b a.c b", "Ément ÉMENT ement", "press #️⃣ now #", "x " * 9, "á ß_ß 3.5 o'neil", "😀 😀!", "́ _́"]
    read = spark.sparkContext.accumulator(0)

    def seen(text):
        read.add(1)
        return text

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, body string").repartition(3)
    held = df.withColumn("body", F.udf(seen, "string").asNondeterministic()("body"))
    made = index.build_index(SearchModel(held, pk="id", name="texts"), f"{tmp_path}/once")
    assert read.value == len(texts)
    model = SearchModel(df.withColumn("other/name", F.reverse("body")), pk="id", name="texts")
    both = index.build_index(model, f"{tmp_path}/both", ["body", "other/name"])
    for found, field, text in ((made, "body", "body"), (both, "body", "body"), (both, "other/name", "other/name")):
        words = model.df.select("id", tokens(F.col(f"`{text}`")).alias("t"))
        want = words.select("id", F.size("t").alias("dl"), F.posexplode("t")).groupBy("id", "col", "dl").agg(F.sort_array(F.collect_list(F.col("pos") + 1)).alias("places"))
        got = found.postings.where(F.col("field") == field).select("pk", "term", "dl", "places", "tf")
        assert sorted(map(tuple, got.collect())) == sorted((r.id, r.col, r.dl, r.places, len(r.places)) for r in want.collect())
        assert sorted(map(tuple, found.rows.where(F.col("field") == field).select("pk", "dl").collect())) == sorted((r.id, len(r.t)) for r in words.collect())
        assert index.fsck(found).count() == 0
    nothing = index.build_index(SearchModel(df.limit(0), pk="id", name="texts"), f"{tmp_path}/nothing")
    assert nothing.postings.count() == 0 and nothing.counts == {"body": (0, 1.0)}


def test_a_phrase_is_counted_with_its_documents_put_together_once(spark, tmp_path):
    df = spark.createDataFrame([(i, "x licensed y under licensed under" if i % 2 else "under licensed") for i in range(6)], "id long, body string")
    made = index.build_index(SearchModel(df, pk="id", name="texts"), f"{tmp_path}/phrase")
    node = tinql.compiled("licensed under")[1]
    counted = made.holding("body", node, index.documents_of(made, "body", node).passed)
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_repeat(") == 2  # those of putting one document together
    assert counted.first().n == 3


def test_an_index_is_written_in_segments_without_a_shuffle_of_postings(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "SEGMENT_TOKENS", 5)
    texts = ["b a", "", "c b a", "d " * 12, None, "a", "a b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, body string").coalesce(1)
    made = index.build_index(SearchModel(df, pk="id", name="texts"), f"{tmp_path}/segments")
    held = made.segments.select("term", "pks").collect()
    assert [(r.term, r.pks) for r in held] == [(None, [0, 1, 2]), ("a", [0, 2]), ("b", [0, 2]), ("c", [2]), (None, [3]), ("d", [3]), (None, [4, 5, 6]), ("a", [5, 6]), ("b", [6])]
    assert index.segments_of(index.rows_of(SearchModel(df, pk="id", name="texts"), ["body"]))._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0
    assert sorted(map(tuple, made.dictionary.select("term", "df").collect())) == [("a", 4), ("b", 3), ("c", 1), ("d", 1)]
    few = sorted((r.pk, sorted(r.tokens), r.dl) for r in made.bags("body", ["a", "d"]).collect())
    monkeypatch.setattr(index, "FEW_TERMS", 0)
    assert few == sorted((r.pk, sorted(r.tokens), r.dl) for r in made.bags("body", ["a", "d"]).collect()) == [(0, ["a"], 2), (2, ["a"], 3), (3, ["d"] * 12, 12), (5, ["a"], 1), (6, ["a"], 2)]
    assert made.counts == {"body": (7, 20 / 7)} and index.fsck(made).count() == 0
