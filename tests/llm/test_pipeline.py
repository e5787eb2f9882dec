import random
import zlib

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from lodestone.llm import pii
from test_minhash import brute as near_brute
from test_pii import base_spans
from test_suffixes import brute as repeat_brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select(*cp.COLUMNS).collect()]
    rng = random.Random(6)
    new = 10**6
    for d in rng.sample(docs, 8):  # exact and near copies, a passage, personal data
        words = d[1].split(" ")
        docs.append((new, d[1], *d[2:]))
        docs.append((new + 1, " ".join([*words, "und"]), *d[2:]))
        docs.append((new + 2, "Andhe orting " + d[1][:400] + " thebe rened", *d[2:]))
        docs.append((new + 3, f"Rentin of {new} oner the mail a{new}@b.example.org or 4111 1111 1111 1111 ance the", *d[2:]))
        new += 10
    docs += [(new, None, "en", "src0", None), (new + 1, "", None, None, 0), (new + 2, "123 456 !!", "en", "src1", 10)]
    return docs


def test_stages_against_brute_force(spark, sf):
    docs = corpus(spark, sf)
    known = {d[0]: d for d in docs}
    out = cp.language(spark, spark.createDataFrame(docs, SCHEMA), sf).collect()
    letters = {d[0] for d in docs if any(c.isalpha() for c in d[1] or "")}
    assert {r.doc_id for r in out} == letters
    assert all(tuple(r)[:2] == known[r.doc_id][:2] and r.n_chars == known[r.doc_id][4] for r in out)

    docs = [tuple(r) for r in out]
    out = cp.near_duplicates(spark, spark.createDataFrame(docs, SCHEMA), sf).collect()
    groups = near_brute([d[:2] for d in docs])
    assert sorted(r.doc_id for r in out) == sorted(i for i, (_, c) in groups.items() if i == c)

    docs = [tuple(r) for r in out]
    out = cp.repeated_passages(spark, spark.createDataFrame(docs, SCHEMA), sf).collect()
    cut = repeat_brute([d[:2] for d in docs])
    left = {r.doc_id: r for r in out}
    for d in docs:
        n, gone, _, _ = cut[d[0]]
        if gone == 0:
            assert tuple(left[d[0]]) == d
        elif gone == n:
            assert d[0] not in left
        else:
            assert n - gone - 8 * (1 + n) < len(left[d[0]].text.encode()) <= n - gone and left[d[0]].n_chars == len(left[d[0]].text)

    docs = [tuple(r) for r in out]
    out = cp.personal_data(spark, spark.createDataFrame(docs, SCHEMA), sf).collect()
    assert len(out) == len(docs)
    for d, r in zip(sorted(docs), sorted(map(tuple, out)), strict=True):
        assert (r[1] == d[1]) or pii.find_spans and "<" in r[1]
        assert not base_spans(d[1]) or r[1] != d[1]
        assert not [s for s in base_spans(r[1]) if s[0] == "email"]

    docs = [tuple(r) for r in out]
    out = cp.packed(spark, spark.createDataFrame(docs, SCHEMA), sf).collect()
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pieces = {(r.doc_id, r.piece): r for r in out}
    for d in docs:
        ids = [*tokenizer.encode(d[1], add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            r = pieces.pop((d[0], k))
            assert (r.start, r.length, r.ids_crc32) == (a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
    assert not pieces


def test_run_and_odd_tables(spark, sf, tmp_path):
    assert cp.run(spark, sf).count() > 0
    text = "and the other one of them is that this was not for you with all "
    rows = [(1, text, "en", "s", 5, "x"), (1, text, "en", "s", 5, "x"), (None, text, None, None, None, "x"), (2, None, "en", "s", 0, "x")]
    df = spark.createDataFrame(rows, SCHEMA + ", language string")
    df.write.parquet(f"{tmp_path}/a/documents.parquet")
    assert {r.doc_id for r in cp.run(spark, f"{tmp_path}/a").collect()} == {1, None}
    df.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert cp.run(spark, f"{tmp_path}/b").count() == 0
    assert cp.language(spark, df, sf).columns == list(cp.COLUMNS) and F is not None


def test_each_stage_on_odd_tables(spark, sf):
    """Nulls in every column, repeated rows, no rows, and further columns whose names the stages use themselves."""
    text = "and the other one of them is that this was not for you with all and the house of it "
    rows = [(1, text, "en", "s", 5, "x", 1), (1, text, "en", "s", 5, "x", 1), (None, None, None, None, None, None, None), (2, "", None, None, 0, "x", 2), (3, "that house is the other one for you with this and all of them " * 2, None, "s", None, "x", 3)]
    df = spark.createDataFrame(rows, SCHEMA + ", spans string, n int")
    expected = {"language": {1, 3}, "near_duplicates": {1, 2, 3, None}, "repeated_passages": {1, 2, 3, None}, "personal_data": {1, 2, 3, None}, "packing": {1, 2, 3, None}}
    for name, stage in cp.STAGES:
        out = stage(spark, df, sf)
        found = {r.doc_id for r in out.collect()}
        assert found == expected[name], name
        assert stage(spark, df.limit(0), sf).count() == 0
        if name != "packing":
            assert out.columns == list(cp.COLUMNS)
