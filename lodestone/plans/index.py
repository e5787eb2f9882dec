"""A stored text index: postings with places, lengths by row, a dictionary and corpus counts.

The inline plan tokenises a table as it is searched.  With an index, words, prefixes and misspellings are looked up in the
dictionary, and only postings of the terms that match are read, whatever the expression: where the places of words matter,
a document's tokens are put together from its postings, with nothing between the words that are asked for.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidQueryError
from ..functions.analysis import casing, query_tokens, tokens
from ..operators.scoring import B, K1
from ..operators.spans import Node, Test, let
from ..sources.model import SearchModel
from ..storage import session_folder

#: Expanded terms that are looked up at most; searches that take in more read the table instead.
MAX_TERMS = 10_000
#: Terms that are compared in the scan, where they prune row groups; more are broadcast.
FEW_TERMS = 200
#: Documents that are broadcast at most to the tables they are looked up in; more are joined by a shuffle.
MAX_BROADCAST_ROWS = 100_000


@dataclass(frozen=True)
class TextIndex:
    """Frames of an index: segments (see SEGMENT), dictionary (field, term, df), corpus (field, n, mean, cased)."""

    segments: DataFrame
    dictionary: DataFrame
    corpus: DataFrame
    pk: str
    cased: bool = False

    @functools.cached_property
    def rows(self) -> DataFrame:
        """(pk, dl, field) of each document."""
        each = self.segments.where("term is null").select("field", F.explode(F.arrays_zip("pks", "dls")).alias("x"))
        return each.select(F.col("x.pks").alias("pk"), F.col("x.dls").alias("dl"), "field")

    @functools.cached_property
    def postings(self) -> DataFrame:
        """(pk, term, tf, places, dl, field) of each document and distinct term."""
        return _unpacked(self.segments.where("term is not null"))

    @functools.cached_property
    def counts(self) -> dict[str, tuple[int, float]]:
        """Documents and mean length of each field."""
        return {r.field: (r.n, r["mean"] or 1.0) for r in self.corpus.collect()}

    def covers(self, fields: list[str], cased: bool) -> bool:
        return self.cased == cased and set(fields) <= set(self.counts)

    def matching(self, name: str, tests: list[Test]) -> list[tuple[str, int, list[bool]]] | None:
        """(term, documents, which tests it passes) of the field's terms that pass a test; None if they are too many."""
        if not tests:
            return []
        term = F.col("term")
        known = self.dictionary.where(F.col("field") == name).where(functools.reduce(lambda a, b: a | b, [t(term) for t in tests]))
        rows = known.select("term", "df", F.array(*(F.coalesce(t(term), F.lit(False)) for t in tests)).alias("passed")).limit(MAX_TERMS + 1).collect()
        return None if len(rows) > MAX_TERMS else [(r.term, r.df, r.passed) for r in rows]

    def bags(self, name: str, terms: list[str], placed: bool = False) -> DataFrame:
        """(pk, tokens, dl) of each document that holds any of the terms: these terms as often as it does, in any order, or
        all its tokens with nulls for other words."""
        held = self.segments.where(F.col("field") == name)
        if len(terms) <= FEW_TERMS:
            held = held.where(F.col("term").isin(terms))
        else:
            held = held.join(F.broadcast(held.sparkSession.createDataFrame([(t,) for t in terms], "term string")), "term", "left_semi")
        held = _unpacked(held)
        if placed:
            each = F.transform("places", lambda p: F.struct(p.alias("place"), F.col("term")))
            docs = held.groupBy("pk").agg(F.array_sort(F.flatten(F.collect_list(each))).alias("held"), F.first("dl").alias("dl"))
            return docs.select("pk", _spread_out(F.col("held"), F.col("dl")).alias("tokens"), "dl")
        if len(terms) == 1:
            return held.select("pk", F.array_repeat("term", F.col("tf").cast("int")).alias("tokens"), "dl")
        return held.groupBy("pk").agg(F.flatten(F.collect_list(F.array_repeat("term", F.col("tf").cast("int")))).alias("tokens"), F.first("dl").alias("dl"))

    def holding(self, name: str, word: Node, passed: dict[int, list[tuple[str, int]]]) -> int | DataFrame:
        """How many documents hold a word: known, or one row (n) to be asked for."""
        terms = {term: df for group in word.needs or [] for t in group for term, df in passed[id(t)]}
        if not terms:
            return 0
        if len(terms) == 1 and not word.positional:
            return next(iter(terms.values()))
        found = documents_of(self, name, word)
        return found.docs.where(let(F.col("tokens"), word.hit)).agg(F.count("*").alias("n"))


def _unpacked(segments: DataFrame) -> DataFrame:
    each = segments.select("field", "term", F.explode(F.arrays_zip("pks", "tfs", "places", "dls")).alias("x"))
    return each.select(F.col("x.pks").alias("pk"), "term", F.col("x.tfs").alias("tf"), F.col("x.places").alias("places"), F.col("x.dls").alias("dl"), "field")


def _spread_out(held: Column, length: Column) -> Column:
    """An array of so many tokens: those of held, (place, term) in order, at their places, and nulls."""
    nothing = F.lit(None).cast("string")

    def spread(words: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            before = F.coalesce(F.get(words, i - 1)["place"], F.lit(0))
            return F.concat(F.array_repeat(nothing, x["place"] - before - 1), F.array(x["term"]))

        rest = F.array_repeat(nothing, (length - F.element_at(words, -1)["place"]).cast("int"))
        return F.concat(F.flatten(F.transform(words, one)), rest)

    return let(held, spread)


@dataclass(frozen=True)
class Found:
    """The documents (pk, tokens, dl) that hold words of a node or of what is excluded, how many can match at most, and by
    the identity of each test the terms that pass it, with their documents."""

    docs: DataFrame
    most: int
    passed: dict[int, list[tuple[str, int]]]


def held_small(df: DataFrame, most: int) -> DataFrame:
    """df, to be broadcast if it has few rows at most."""
    return F.broadcast(df) if most <= MAX_BROADCAST_ROWS else df


def documents_of(index: TextIndex, name: str, node: Node, excluded: list[Node] = ()) -> Found | None:
    """What the index has for a node in a field, and for others that are held against it.  None if it can't tell: the node
    may match without any of its words, or all take in too many terms."""
    if node.needs is None or any(x.needs is None for x in excluded):
        return None
    tests = list({id(t): t for n in (node, *node.words(), *excluded) for t in n.tests}.values())
    known = index.matching(name, tests)
    if known is None:
        return None
    passed = {id(t): [(term, df) for term, df, flags in known if flags[k]] for k, t in enumerate(tests)}
    most = min((sum({term: df for t in group for term, df in passed[id(t)]}.values()) for group in node.needs), default=0)
    terms = [term for term, _, _ in known]
    if not terms:
        return Found(index.rows.select("pk", F.array().cast("array<string>").alias("tokens"), "dl").limit(0), 0, passed)
    return Found(index.bags(name, terms, node.positional or any(x.positional for x in excluded)), most, passed)


def rows_of(model: SearchModel, fields: list[str]) -> DataFrame:
    """(pk, field, tokens, dl)"""
    each = F.array(*(F.struct(F.lit(f).alias("field"), tokens(F.col(f"`{f}`").cast("string")).alias("tokens")) for f in fields))
    return model.df.select(F.col(f"`{model.pk}`").alias("pk"), F.explode(each).alias("x")).select("pk", "x.field", "x.tokens", F.size("x.tokens").alias("dl"))


def postings_of(rows: DataFrame) -> DataFrame:
    """One row for each document and distinct term, with its places, cut within the batch without a shuffle."""
    kinds = {f.name: f.dataType for f in rows.schema}
    schema = T.StructType([T.StructField("pk", kinds["pk"]), T.StructField("field", T.StringType()), *(T.StructField(n, T._parse_datatype_string(k)) for n, k in POSTING), T.StructField("dl", T.IntegerType())])
    bounded_batches(rows.sparkSession)
    return rows.select("pk", "field", "tokens").mapInArrow(functools.partial(_cut, most=CUT_TOKENS), schema)


def segments_of(rows: DataFrame) -> DataFrame:
    """rows (pk, tokens) cut into segments without a shuffle: SEGMENT_TOKENS tokens of a task's rows, or one row that has more."""
    kind = {f.name: f.dataType for f in rows.schema}["pk"]
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("docs", T.IntegerType()), T.StructField("pks", T.ArrayType(kind)), *(T.StructField(n, T._parse_datatype_string(k)) for n, k in SEGMENT)])
    bounded_batches(rows.sparkSession)
    return rows.select("pk", "tokens").mapInArrow(functools.partial(_segments, most=SEGMENT_TOKENS), schema)


POSTING = (("term", "string"), ("tf", "int"), ("places", "array<int>"))
#: A row for each term of a segment, in order, with its documents; the row without a term has all documents of the segment.
SEGMENT = (("tfs", "array<int>"), ("places", "array<array<int>>"), ("dls", "array<int>"))
#: Tokens that are cut together.
CUT_TOKENS = 400_000
#: Tokens of a segment, and rows of it that stand on a page of its file: what a look-up reads at least.
SEGMENT_TOKENS = 1_000_000
PAGE_ROWS = 1_000
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of so many bytes, unless the session says otherwise: rows are whole texts."""
    if not spark.conf.get(_BYTES, None) or int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) > 1 << 26:
        spark.conf.set(_BYTES, "16m")


def _sizes(batch: pa.RecordBatch) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(batch.column("tokens")), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _parts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The batches' rows in parts of at most so many tokens, or of one row."""
    for batch in batches:
        ends, at = np.cumsum(_sizes(batch)), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def _cut(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for part in _parts(batches, most):
        sizes = _sizes(part)
        words = part.column("tokens").flatten().dictionary_encode()
        docs, codes, each = _postings(words.indices.to_numpy(zero_copy_only=False), sizes)
        owner = pa.array(docs)
        yield pa.RecordBatch.from_pydict({
            "pk": part.column("pk").take(owner), "field": part.column("field").take(owner), "term": words.dictionary.take(pa.array(codes)),
            "tf": each.value_lengths(), "places": each, "dl": pa.array(sizes[docs].astype(np.int32)),
        })


def _postings(codes: np.ndarray, sizes: np.ndarray, by_term: bool = False) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
    """(document, code, places) of each posting, by document and code or the other way round; places are in order."""
    codes = codes.astype(np.int64)
    docs = np.repeat(np.arange(len(sizes)), sizes)
    places = np.arange(1, len(codes) + 1) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    many = int(codes.max(initial=0)) + 1
    order = np.argsort(codes if by_term else docs * many + codes, kind="stable")  # tokens come by document
    codes, docs, places = codes[order], docs[order], places[order].astype(np.int32)
    first = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (docs[1:] != docs[:-1])]) if len(codes) else np.zeros(0, np.int64)
    return docs[first], codes[first], pa.ListArray.from_arrays(pa.array(np.append(first, len(codes)).astype(np.int32)), pa.array(places))


def _segments(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    held, tokens_held = [], 0
    for part in _parts(batches, most):
        n = int(_sizes(part).sum())
        if held and tokens_held + n > most:
            yield from _segment(held)
            held, tokens_held = [], 0
        held.append(part)
        tokens_held += n
    if held:
        yield from _segment(held)


def _segment(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(parts).combine_chunks()
    pk, words = (rows.column(n).chunk(0) for n in ("pk", "tokens"))
    sizes = _sizes(rows.to_batches()[0])
    every = pa.array([0, len(sizes)], pa.int32())
    held = {"term": pa.nulls(1, pa.string()), "docs": pa.array([len(sizes)], pa.int32()), "pks": pa.ListArray.from_arrays(every, pk), "tfs": pa.nulls(1, pa.list_(pa.int32())), "places": pa.nulls(1, pa.list_(pa.list_(pa.int32()))), "dls": pa.ListArray.from_arrays(every, pa.array(sizes.astype(np.int32)))}
    yield pa.RecordBatch.from_pydict(held)
    words = words.flatten().dictionary_encode()
    if not len(words):
        return
    by_text = pc.sort_indices(words.dictionary).to_numpy()
    rank = np.empty(len(by_text), np.int64)
    rank[by_text] = np.arange(len(by_text))
    docs, codes, each = _postings(rank[words.indices.to_numpy(zero_copy_only=False)], sizes, by_term=True)
    edges = np.append(np.searchsorted(codes, np.arange(len(by_text))), len(codes)).astype(np.int32)
    bounds, tfs, dls = pa.array(edges), each.value_lengths(), pa.array(sizes[docs].astype(np.int32))
    made = pa.RecordBatch.from_pydict({
        "term": words.dictionary.take(pa.array(by_text)), "docs": pa.array(np.diff(edges)), "pks": pa.ListArray.from_arrays(bounds, pk.take(pa.array(docs))),
        "tfs": pa.ListArray.from_arrays(bounds, tfs), "places": pa.ListArray.from_arrays(bounds, each), "dls": pa.ListArray.from_arrays(bounds, dls),
    })
    for at in range(0, made.num_rows, 10 * PAGE_ROWS):
        yield made.slice(at, 10 * PAGE_ROWS)


def build_index(model: SearchModel, path: str, fields: list[str] | None = None) -> TextIndex:
    """Writes the index under path, in one pass over the texts: each task writes segments, which hold the postings of its
    documents by term, so that look-ups read few pages of each.  Only the dictionary is shuffled, a row for each term of a segment.
    """
    names = fields or model.text_fields()
    spark = model.df.sparkSession
    kinds = ", ".join(["term string", "docs int", f"pks array<{model.column_type(model.pk)}>", *(f"{n} {k}" for n, k in SEGMENT), "field string"])
    spark.createDataFrame([], kinds).write.mode("overwrite").partitionBy("field").parquet(f"{path}/segments")
    for name in names:
        with casing(model.case_sensitive):
            made = segments_of(rows_of(model, [name]))
        folder = f"field={spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(name)}"
        made.write.mode("overwrite").option("parquet.page.row.count.limit", PAGE_ROWS).parquet(f"{path}/segments/{folder}")
    segments = spark.read.parquet(f"{path}/segments")
    # dealt out by ranges, in which the sums need no shuffle of their own
    terms = segments.where("term is not null").select("field", "term", "docs").repartitionByRange("field", "term").groupBy("field", "term").agg(F.sum("docs").alias("df"))
    terms.sortWithinPartitions("field", "term").write.mode("overwrite").parquet(f"{path}/dictionary")
    rows = TextIndex(segments, terms, terms, model.pk).rows
    counted = {r.field: (r.n, r["mean"]) for r in rows.groupBy("field").agg(F.count("*").alias("n"), F.avg("dl").alias("mean")).collect()}
    spark.createDataFrame([(n, *counted.get(n, (0, None)), model.case_sensitive) for n in names], "field string, n long, mean double, cased boolean").coalesce(1).write.mode("overwrite").parquet(f"{path}/corpus")
    return open_index(spark, path, model.pk)


def open_index(spark: SparkSession, path: str, pk: str) -> TextIndex:
    frames = [spark.read.parquet(f"{path}/{t}") for t in ("segments", "dictionary", "corpus")]
    return TextIndex(*frames, pk, bool(frames[2].agg(F.max("cased")).first()[0]))


_built: dict[tuple[str, str], TextIndex] = {}


def session_index(model: SearchModel, key: str) -> TextIndex:
    """The index of a model under a key, built at first use; it goes when the session ends."""
    spark = model.df.sparkSession
    name = (spark.sparkContext.applicationId, key)
    if name not in _built:
        _built[name] = build_index(model, session_folder(spark, "index"))
    return _built[name]


def fsck(index: TextIndex) -> DataFrame:
    """(field, problem, n) of what doesn't fit together; no rows where all does."""
    lengths = index.postings.groupBy("field", "pk").agg(F.sum("tf").alias("held"), F.max("dl").alias("said"))
    bad = lengths.join(index.rows.select("field", "pk", "dl"), ["field", "pk"], "left").where("dl is null or held != dl or said != dl").select("field", F.lit("postings don't fit their row").alias("problem"))
    terms = index.postings.groupBy("field", "term").agg(F.count("*").alias("held")).join(index.dictionary, ["field", "term"], "full").where("held is null or df is null or held != df")
    counts = index.rows.groupBy("field").agg(F.count("*").alias("held"), F.avg("dl").alias("average")).join(index.corpus, "field", "full").where("held is distinct from nullif(n, 0) or abs(average - mean) > 1e-9")
    every = bad.union(terms.select("field", F.lit("a term's documents don't fit the dictionary"))).union(counts.select("field", F.lit("documents don't fit the corpus counts")))
    return every.groupBy("field", "problem").agg(F.count("*").alias("n"))


def expanded(index: TextIndex, field: str, word: str, mode: str, reach: tuple[int, int] | None) -> DataFrame:
    """(term, df): the dictionary's terms that a query word takes in."""
    known = index.dictionary.where(F.col("field") == field)
    term = F.col("term")
    if mode == "word_start":
        test = term.startswith(word)
    elif mode == "word_middle":
        test = term.contains(word)
    elif mode == "word_end":
        test = term.endswith(word)
    elif reach and reach[0]:
        test = term.startswith(word[: reach[1]]) & (F.levenshtein(term, F.lit(word), reach[0]) >= 0)
    else:
        test = term == word
    return known.where(test).select("term", "df")


def postings_search(index: TextIndex, field: str, term: str, mode: str = "word", together: str = "and", reach: tuple[int, int] | None = None) -> DataFrame:
    """(pk, _score) of the documents that hold all or any words, by BM25 summed over the terms a word takes in.

    The terms are broadcast if they are few; the only shuffle is the sum over the matching postings of each document.
    """
    words = list(dict.fromkeys(query_tokens(term)))
    if mode not in ("word", "word_start", "word_middle", "word_end"):
        raise InvalidQueryError("the postings plan takes word modes")
    if not words:
        return index.postings.select(F.col("pk").alias(index.pk), F.lit(0.0).alias("_score")).limit(0)
    found = None
    for k, word in enumerate(words):
        one = expanded(index, field, word, mode, reach).withColumn("word", F.lit(k))
        found = one if found is None else found.union(one)
    few = found.limit(MAX_TERMS + 1).count() <= MAX_TERMS
    stats = index.corpus.where(F.col("field") == field).first()
    n, mean = (stats.n, stats["mean"] or 1.0) if stats else (0, 1.0)
    hits = index.postings.where(F.col("field") == field).join(F.broadcast(found) if few else found, "term")
    weight = F.ln(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = weight * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / mean))
    docs = hits.groupBy("pk").agg(F.sum(score).alias("_score"), F.count_distinct("word").alias("words"))
    return docs.where(F.col("words") >= (len(words) if together == "and" else 1)).select(F.col("pk").alias(index.pk), "_score")
