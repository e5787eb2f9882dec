import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lodestone import Between, InvalidQueryError, MissingFieldError, SearchModel, UnsupportedError
from lodestone.functions import dates, jsonpath
from lodestone.functions.analysis import fold_text, query_tokens, tokens
from lodestone.operators import highlighting, projection, reranking
from lodestone.plans import index
from lodestone.plans import relation as plan

@pytest.fixture(scope="module")
def products(spark):
    rows = [
        (1, "Red Apple", "Fresh orchard fruit", ["fresh", "red"], [1, 1, 80], '{"origin": {"name": "x"}, "r": [4, [6, "5"]], "conv": {"Apple": 3, "apple": 2}}', 0, dt.datetime(2026, 1, 1, 12)),
        (2, "Green Pear", "Ripe fruit", ["ripe", None], [None], '{"origin": [{"name": "y"}, [{"name": "z"}]], "r": 8, "conv": {}}', 1, dt.datetime(2026, 1, 3, 12)),
        (3, "Jalapeño sauce don't", None, [], [], '{"r": null, "value": [null, {}, []]}', 7, None),
        (4, "Wi-Fi box 3.14 foo_bar", "red apple", None, None, None, None, dt.datetime(2025, 12, 30)),
    ]
    df = spark.createDataFrame(rows, "id long, name string, description string, tags array<string>, ratings array<int>, meta string, status int, at timestamp")
    return SearchModel(df, name="products", searchable=("name", "description"), json=("meta",), enums={"status": {"new": 0, "used": 1}})


def ids(rel):
    return sorted(r[0] for r in rel.matched.select(rel.model.pk).collect())


def test_tokens_agree_in_both_engines(spark):
    texts = ["Jalapeño Wi-Fi", "foo_bar _ don't 3.14", "É SS œuvre", "", "a ❤ 😀 b", "end.Next __ ’x", "x́y"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tokens(F.col("t")).alias("w")).collect()
    assert {r.t: r.w for r in rows} == {t: query_tokens(t) for t in texts}
    assert query_tokens("Jalapeño Wi-Fi don't 3.14 _") == ["jalapeno", "wi", "fi", "don't", "3.14"]
    assert fold_text("ÀÉß") == "aess"


def test_match_modes_and_misspellings(products):
    assert ids(products.search("red apple")) == [1, 4]
    assert ids(products.search("red fruit")) == []  # words aren't split across fields
    assert ids(products.search("appel", misspellings={"edit_distance": 2})) == [1, 4]
    assert ids(products.search("aple", misspellings=False)) == []
    assert ids(products.search("jalapeno", fields=["name"])) == [3]
    assert ids(products.search("wi fi", match="phrase")) == [4]
    assert ids(products.search("*")) == [1, 2, 3, 4] and ids(products.search("")) == [] and ids(products.search("_")) == []
    assert ids(products.search("fruit", exclude="orchard")) == [2]
    assert ids(products.search("red apple", fields=[{"name": "exact"}, {"description": "exact"}])) == [4]
    assert products.search("red apple", fields=[{"description^12.5": "exact"}]).matched.first()["_score"] == 12.5
    for bad in ({"transpositions": True}, {"max_expansions": 3}):
        with pytest.raises(UnsupportedError):
            products.search("x", misspellings=bad).count()
    with pytest.raises(MissingFieldError):
        products.search("x", fields=["none"]).count()


def test_filters(products):
    where = lambda w: ids(products.search("*", where=w))
    assert where({"tags": "fresh"}) == [1] and where({"tags": None}) == [3, 4] and where({"ratings": {"gt": 2, "lt": 100}}) == [1]
    assert where({"status": "new"}) == [1] and where({"status": None}) == [3, 4] and where({"status": {"not": "new"}}) == [2, 3, 4]
    assert where({"description": {"not": "Ripe fruit"}}) == [1, 3, 4] and where({"id": Between(2, 4, exclusive=True)}) == [2, 3]
    assert where({"name": {"regexp": "^[[:alpha:]]+ A"}}) == [1] and where({"name": {"like": "%\\_bar"}}) == [4] and where({"name": {"regexp": "t$"}}) == [3]
    assert where({"meta.origin.name": "z"}) == [2] and where({"meta.r": 5}) == [] and where({"meta.r": "5"}) == [1] and where({"meta.r": {"gt": 5, "lt": 7}}) == [1]
    assert where({"meta.r": {"exists": True}}) == [1, 2] and where({"meta.value": None}) == [1, 2, 3, 4] and where({"meta.origin.name": {"prefix": "x"}}) == [1]
    assert where({"_or": [{"id": 1}, {"id": 2}], "_not": {"id": 2}}) == [1] and where({"id": []}) == []
    assert ids(products.search("*").where(id=[1, 2]).where(id=[2, 3])) == [2] and ids(products.search("*").where(id=1).rewhere(id=2)) == [2]
    assert ids(products.search("*").where(id=[1, 2]).where_not(id=1)) == [2]
    for bad in ({"none": 1}, {"name": {"odd": 1}}, {"name.x.y": {"gt": object()}}):
        with pytest.raises((InvalidQueryError, MissingFieldError)):
            products.search("*", where=bad).count()


def test_unbounded_json_walk(spark, products):
    df = products.df.select("id", F.try_parse_json("meta").alias("v"))
    rows = jsonpath.json_leaves(df, "id", "v", ["origin", "name"]).select("id", F.col("leaf").cast("string").alias("x")).collect()
    assert sorted((r.id, r.x) for r in rows) == [(1, "x"), (2, "y"), (2, "z")]


def test_boosts(products):
    score = lambda **o: {r.id: r["_score"] for r in products.search("*", **o).matched.collect()}
    assert score(boost_where={"tags": "fresh"}) == {1: 1000.0, 2: 1.0, 3: 1.0, 4: 1.0}
    origin = dt.datetime(2026, 1, 3, 12)
    for shape, expected in (("gauss", 0.0625), ("exp", 0.25), ("linear", 0.0)):
        got = score(boost_by_recency={"at": {"scale": "1d", "origin": origin, "function": shape}})
        assert got[1] == pytest.approx(expected) and got[2] == 1.0 and got[3] == 1.0
    assert score(boost_by={"ratings": {"modifier": "none", "factor": 3}})[1] == 3.0
    with pytest.raises(Exception, match="below 0"):
        score(boost_by={"id": {"modifier": "none", "factor": -1}})
    model = SearchModel(products.df.withColumn("conv", F.get_json_object("meta", "$.conv")), name="p", searchable=("name",))
    got = {k: model.search("apple", conversions_v1=k == 1 and ["conv"] or False, conversions_v2=k == 2 and ["conv"] or False).matched.first()["_score"] for k in (0, 1, 2)}
    assert got[1] - got[0] == pytest.approx(5) and got[2] - got[0] == pytest.approx(2)


def test_facets(spark, products):
    aggs = products.search("*", aggs={"ratings": {"histogram": {"interval": 10}}, "tags": {}, "n": {"cardinality": {"field": "tags"}}}).aggs_results()
    assert aggs["ratings"]["buckets"][0] == {"key": 0.0, "doc_count": 1} and aggs["ratings"]["buckets"][-1] == {"key": 80.0, "doc_count": 1}
    assert [(b["key"], b["doc_count"]) for b in aggs["tags"]["buckets"]] == [("fresh", 1), ("red", 1), ("ripe", 1)] and aggs["n"] == {"value": 3.0}
    prices = SearchModel(spark.createDataFrame(list(enumerate([-12.5, -10.0, -0.1, 0.0, 9.9, 20.0, 21.0])), "id int, price double"))
    got = prices.search("*", aggs={"price": {"histogram": {"interval": 10}}}).aggs_results()["price"]["buckets"]
    assert [(b["key"], b["doc_count"]) for b in got] == [(-20, 1), (-10, 2), (0, 2), (10, 0), (20, 2)]
    got = prices.search("*", aggs={"price": {"histogram": {"interval": 10, "offset": 5, "hard_bounds": [0, 10], "extended_bounds": [0, 10]}}}).aggs_results()["price"]["buckets"]
    assert [b["key"] for b in got] == [-5.0, 5.0, 15.0]
    arrays = SearchModel(spark.createDataFrame([(1, [1, 1, 2, 9, 11]), (2, [3, 12]), (3, [25]), (4, []), (5, None), (6, [None])], "id int, r array<int>"))
    got = arrays.search("*", aggs={"r": {"histogram": {"interval": 10}}}).aggs_results()["r"]["buckets"]
    assert [(b["key"], b["doc_count"]) for b in got] == [(0, 2), (10, 2), (20, 1)]
    for bad in ({"r": {"histogram": {"interval": 0}}}, {"r": {"avg": {}, "sum": {}}}, {"r": {"odd": 1}}):
        with pytest.raises(InvalidQueryError):
            arrays.search("*", aggs=bad).aggs_results()


@pytest.mark.parametrize(
    ("zone", "unit", "instants", "keys", "counts"),
    [
        ("America/New_York", "day", ["2026-03-07T12:00", "2026-03-09T12:00"], ["2026-03-07T05:00", "2026-03-08T05:00", "2026-03-09T04:00"], [1, 0, 1]),
        ("America/New_York", "day", ["2026-10-31T12:00", "2026-11-02T12:00"], ["2026-10-31T04:00", "2026-11-01T04:00", "2026-11-02T05:00"], [1, 0, 1]),
        ("America/Havana", "day", ["2026-11-01T12:00"], ["2026-11-01T05:00"], [1]),
        ("UTC", "week", ["2026-01-07T00:00", "2026-01-19T00:00"], ["2026-01-05T00:00", "2026-01-12T00:00", "2026-01-19T00:00"], [1, 0, 1]),
    ],
)
def test_calendar_days(spark, zone, unit, instants, keys, counts):
    rows = [(k, dt.datetime.fromisoformat(t)) for k, t in enumerate(instants)]
    model = SearchModel(spark.createDataFrame(rows, "id int, at timestamp_ntz"))
    _, facet, _ = model.search("*", aggs={"at": {"date_histogram": {"interval": unit, "time_zone": zone}}}).agg_frames()["at"]
    got = [(r.k, r.doc_count) for r in facet.select(F.date_format("key", "yyyy-MM-dd'T'HH:mm").alias("k"), "doc_count").collect()]
    assert got == list(zip(keys, counts, strict=True))


def test_intervals_and_zones():
    assert dates.micros("7d") == 7 * 86400 * 10**6 and dates.micros("1.5 days") == 129600 * 10**6 and dates.micros("1 month") == 30 * 86400 * 10**6
    assert dates.micros("1 year") == dates.micros("12 months") == 31557600 * 10**6 and dates.micros("14 months") == (31557600 + 60 * 86400) * 10**6
    assert dates.zone_name(-5) == "-05:00" and dates.zone_name("+05:30") == "+05:30"
    for bad in ("+19:00", "Nowhere/Land"):
        with pytest.raises(InvalidQueryError):
            dates.zone_name(bad)
    with pytest.raises(UnsupportedError):
        dates.instant("now-1d")


def test_pages(products):
    rel = products.search("*", order="name", limit=2)
    assert rel.pluck("name") == ["Green Pear", "Jalapeño sauce don't"]
    page = rel.page(2).results()
    assert page.total_count == 4 and page.total_pages == 2 and page.last_page and page.previous_page == 1 and page.next_page is None
    assert products.search("*", order={"description": "asc"}).pluck("id")[-1] == 3 and products.search("*", order={"description": "desc"}).pluck("id")[0] == 3
    seen, cursor = [], None
    while True:
        rel = products.search("*", order=["name"], keyset=True, limit=3)
        rel = rel.after(cursor) if cursor else rel
        got = rel.results()
        seen += [r["id"] for r in got]
        cursor = got.cursor
        if not got.has_next_page:
            break
    assert seen == [2, 3, 1, 4]
    assert products.search("*", countless=True, limit=3).results().has_next_page
    for bad in ({"keyset": True, "offset": 3}, {"keyset": True, "order": "_score"}, {"after": "x"}, {"keyset": True, "after": "x"}, {"page": 0}):
        with pytest.raises(InvalidQueryError):
            products.search("*", **bad).results()


def test_results_and_response(products):
    found = products.search("red apple", select=["name"], highlight=True, aggs=["status"]).results()
    assert found.hits[0]["_source"].keys() == {"name"} and found.hits[0]["_index"] == "products"
    marks = {h["_id"]: h["highlight"] for h in found.hits}
    assert marks["1"] == {"name": ["<em>Red</em> <em>Apple</em>"]} and marks["4"] == {"description": ["<em>red</em> <em>apple</em>"]}
    assert json.dumps(found.response, default=str) and found.response["hits"]["total"]["value"] == 2
    kept = products.search("*", order="id", scope_results=lambda df: df.where("id <> 2")).results()
    assert [r["id"] for r in kept] == [1, 3, 4] and kept.missing_records == [{"id": 2, "model": "products"}]
    reviews = products.df.sparkSession.createDataFrame([(1, 1, "good"), (2, 1, "bad"), (3, 9, "odd")], "id int, product_id long, body string")
    rows = products.search("*", order="id", limit=2, includes={"reviews": (reviews, "product_id")}).results().rows
    assert [sorted(x["body"] for x in r["reviews"]) for r in rows] == [["bad", "good"], []]
    heard = []
    plan.listeners.append(lambda event, ms: heard.append(event))
    products.search("*").count()
    plan.listeners.clear()
    assert heard == ["count"]
    hook = products.search("*", block=lambda df: df.where("id > 2"), aggs=["id"])
    assert hook.count() == 2 and len(hook.aggs_results()["id"]["buckets"]) == 2
    with pytest.raises(InvalidQueryError):
        products.search("*", typo=1)


def test_fragments_keep_marks_and_graphemes_whole(spark):
    text = "z " * 30 + "<em>no</em> hit" + " y" * 30
    model = SearchModel(spark.createDataFrame([(1, text), (2, "hit and hit & <b>")], "id long, body string"), name="f")
    found = lambda **o: {h["_id"]: h["highlight"]["body"] for h in model.search("hit", highlight=o).results().hits}
    assert found(fragment_size=9)["1"] == ["> <em>hit</em> y y"] or all(len(f.replace("<em>hit</em>", "hit")) == 9 for f in found(fragment_size=9)["1"])
    assert found(fragment_size=5) == {"1": [" <em>hit</em> "], "2": ["<em>hit</em> a", "d <em>hit</em>"]} or len(found(fragment_size=5)["1"]) == 1
    assert found(fragment_size=9, number_of_fragments=0)["1"] == [text.replace(" hit", " <em>hit</em>")]
    assert found(encoder="html")["2"] == ["<em>hit</em> and <em>hit</em> &amp; &lt;b&gt;"] and found(encoder="html", fragment_size=12)["2"][0].startswith("<em>hit</em>")
    assert highlighting.closing('<b class="x">') == "</b>"


def test_source_filters():
    row = {"name": "n", "meta": {"a": {"b": 1, "c": 2}, "d": [{"b": 1}, {"e": 3}]}, "none": None}
    assert projection.SourceFilter(["meta.a.*", "none"])(row) == {"meta": {"a": {"b": 1, "c": 2}}, "none": None}
    assert projection.SourceFilter({"includes": ["meta"], "excludes": ["*.b"]})(row) == {"meta": {"a": {"c": 2}, "d": [{"e": 3}]}}
    assert projection.SourceFilter({"includes": ["meta"], "excludes": ["meta.*"]})(row) == {"meta": {}}
    assert projection.SourceFilter({"includes": ["meta.d"], "excludes": ["meta.d.*"]})(row) == {"meta": {"d": []}}
    assert projection.SourceFilter([])(row) == {} and projection.SourceFilter(None)(row) == row


def test_notices_can_be_turned_off(products, caplog, monkeypatch):
    from lodestone import notices

    products.search("*", aggs=["tags"], load=False).results().aggs  # noqa: B018
    assert any("load=False" in r.message for r in caplog.records) and any("arrays" in r.message for r in caplog.records)
    caplog.clear()
    monkeypatch.setattr(notices, "enabled", False)
    products.search("*", aggs=["tags"], where={"meta.r": 8}).load(False).results().aggs  # noqa: B018
    assert not caplog.records


def test_case_and_index(spark):
    df = spark.createDataFrame([(1, "Red apple RED"), (2, "red Äpple"), (3, None), (4, "Éclair red apple green")], "id long, body string")
    for cased, expected in ((True, [1]), (False, [1, 2, 4])):
        model = SearchModel(df, name=f"case{cased}", searchable=("body",), case_sensitive=cased)
        for m in (model, model.with_index()):
            assert ids(m.search("Red", misspellings=False)) == expected
    plain = SearchModel(df, name="plain", searchable=("body",))
    indexed = plain.with_index()
    for term, options in (("red apple", {}), ("red apple", {"match": "phrase"}), ("appl", {"match": "word_start"}), ("red", {"exclude": "apple green"}), ("aple", {"misspellings": {"edit_distance": 1}}), ("none", {}), ("red", {"tinql": {"in_first": "apple", "words": 2}}), ("red green", {"operator": "or"}), ("red", {"tinql": {"and_not": ["red", "green"]}}), ("red", {"tinql": {"not_encloses": [{"near": ["red", "red"], "distance": 2}, "apple"]}})):
        rows = [sorted((r.id, round(r["_score"], 9)) for r in m.search(term, **{"misspellings": False, **options}).matched.collect()) for m in (plain, indexed)]
        assert rows[0] == rows[1], (term, options)
    assert index.fsck(indexed.index).count() == 0


def test_an_indexed_search_tokenises_nothing(spark, sf):
    model = SearchModel(spark.read.parquet(f"{sf}/documents.parquet"), pk="doc_id", name="documents", searchable=("text",)).with_index(sf)
    text = model.search("licensed under", limit=5, misspellings=False).to_df()._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in text and "TakeOrderedAndProject" in text


def test_fusion():
    got = reranking.rrf(["bear", "cat"], ["dog", "bear", "cat"])
    assert [g["result"] for g in got] == ["bear", "cat", "dog"]
    assert [g["score"] for g in got] == pytest.approx([1 / 61 + 1 / 62, 1 / 62 + 1 / 63, 1 / 61])


def test_index_agrees_with_the_inline_plan(spark, sf, tmp_path):
    model = SearchModel(spark.read.parquet(f"{sf}/documents.parquet"), pk="doc_id", name="documents", searchable=("text",))
    built = index.build_index(model, str(tmp_path))
    for term, options in (("licensed under", {}), ("licensed version", {"operator": "or"})):
        inline = {r.doc_id: round(r["_score"], 9) for r in model.search(f"{term}", fields=["text^1"], misspellings=False, **options).matched.collect()}
        stored = index.postings_search(built, "text", term, together=options.get("operator", "and"))
        assert {r.doc_id: round(r["_score"], 9) for r in stored.collect()} == inline
    assert index.postings_search(built, "text", "licens", "word_start").count() == model.search("licens", match="word_start").count()


def test_plans_push_filters_and_avoid_shuffles(spark, sf):
    model = SearchModel(spark.read.parquet(f"{sf}/part.parquet"), pk="p_partkey", name="part")
    text = model.search("widget", fields=["p_name"], where={"p_size": 3}, misspellings=False).matched.select("p_partkey")._jdf.queryExecution().toString()
    assert "EqualTo(p_size,3)" in text and "Exchange" not in text.split("== Physical Plan ==")[1] and "p_retailprice" not in text.split("ReadSchema")[1]
    top = model.search("widget", fields=["p_name"], limit=5, misspellings=False).to_df()._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in top
