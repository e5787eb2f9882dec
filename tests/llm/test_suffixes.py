import hashlib
import random

import numpy as np

from lodestone.llm import suffixes


def brute(docs):
    """Each document's bytes that a 100-byte string starting earlier covers."""
    seen, out = set(), {}
    for doc, text in sorted(docs, key=lambda x: x[0]):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - 99):
            if (w := data[i : i + 100]) in seen:
                gone[i : i + 100] = True
            else:
                seen.add(w)
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(data) else 0
        out[doc] = (len(data), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(data, np.uint8)[~gone])).hexdigest())
    return out


def compare(spark, docs, parts=3):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    rows = suffixes.remove_repeats(df).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in rows}
    expected = brute(docs)
    assert len(rows) == len(docs)
    assert {k for k in expected if got[k] != expected[k]} == set()


def test_shared_passages_copies_and_periods(spark):
    rng = random.Random(8)
    text = lambda n, letters="abcdefgh é": "".join(rng.choice(letters) for _ in range(n))
    passages = [text(n) for n in (99, 100, 101, 102, 150, 168, 169, 400, 1000)]
    docs = []
    for i in range(120):
        parts = [text(rng.randint(0, 300))]
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randint(0, 40) if rng.random() < 0.5 else 0
            parts += [p[a : len(p) - (rng.randint(0, 40) if rng.random() < 0.5 else 0)], text(rng.randint(0, 60))]
        docs.append((rng.randint(0, 10**9), "".join(parts)))
    docs += [(5, "a" * 500), (6, "a" * 700), (3, "ab" * 300), (4, "ba" * 200 + "c"), (7, ""), (8, None), (9, "x" * 99), (10, "a" * 100), (11, docs[0][1]), (2 * 10**9, docs[0][1] + docs[1][1])]
    docs = list({d: (d, t) for d, t in docs}.values())
    compare(spark, docs)


def test_thue_morse_words(spark):
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    compare(spark, [(1, a), (2, b), (3, a[:700] + b), (4, (b + a)[500:900])])


def test_groups_larger_than_an_arrow_batch(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rng = random.Random(3)
        line = "".join(rng.choice("abcdefg ") for _ in range(130))
        tail = lambda: "".join(rng.choice("abcdefg ") for _ in range(rng.randint(0, 90)))
        compare(spark, [(i, tail() + line[rng.randint(0, 20) :] + tail()) for i in range(200)], parts=40)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_prefix_doubling_finds_the_same(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    extra = [(10**6, "ab" * 200), (10**6 + 1, "a" * 400), (10**6 + 2, None), (10**6 + 3, "short"), (None, "ab" * 200)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    places = lambda found: {(r.doc_id, k) for r in found.collect() for k in range(r.first, r.last + 1)}
    assert places(suffixes.doubled_windows(df)) == places(suffixes.repeated_windows(df)) != set()


def test_the_query_itself(spark, sf):
    rows = suffixes.op7_suffixes(spark, sf)
    assert rows.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string")]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {r.doc_id: tuple(r)[1:] for r in rows.collect()} == brute(docs)


def test_documents_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    compare(spark, docs)


def test_nulls_repeated_and_no_rows(spark):
    long = "the same words again and again " * 5
    df = spark.createDataFrame([(1, long, "k"), (None, long, "k"), (1, long, "k"), (2, None, "k")], "doc_id long, text string, kept string")
    rows = suffixes.remove_repeats(df).collect()
    assert len(rows) == 4 and [r.n_removed for r in rows if r.doc_id is None] == [0]
    assert len({r.n_removed for r in rows if r.doc_id == 1}) == 1
    assert suffixes.remove_repeats(df.limit(0)).count() == 0


def test_no_shuffle_outlives_its_table(spark):
    def shuffles():
        held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for k in range(held.size()) if (name := held.apply(k).getName()).startswith("shuffle_")}

    text = "".join(chr(97 + i * i % 26) + str(i) for i in range(200))
    df = spark.createDataFrame([(i, text[i:] + text[:i]) for i in range(20)], "doc_id long, text string").repartition(3)
    before = shuffles()
    found = suffixes.repeated_windows(df)
    assert not shuffles() - before
    assert found.count() > 0
