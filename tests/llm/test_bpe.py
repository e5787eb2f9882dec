import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from lodestone.llm import bpe

FILES = ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken")


def library(name):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(name), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(n=2000):
    rng = random.Random(1)
    parts = ["a", "b", "'s", "'", "re", "ll", " ", "  ", "\n", "\t", "1", "½", "é", "😀", "!", "''", "'ve", "'d", "S", " ", "　", "x", "中", "'st", "_", "́"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(n)]
    return [*made, "", "'", "a" * 5000, " " * 3000, "ab" * 999, "ba" * 40 + "n" * 41]


@pytest.mark.parametrize("name", FILES)
def test_ids_equal_the_library(name, spark, sf):
    library_ids = library(name)
    texts = odd_texts() + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for first, last, ids, bounds, data, places in bpe.encode_texts(texts, bpe.replay_table(P.path(name))):
        for i in range(first, last):
            got = ids[bounds[i - first] : bounds[i - first + 1]]
            assert data[places[i - first] : places[i - first + 1]].tobytes() == texts[i].encode()
            assert got.tolist() == library_ids.encode_ordinary(texts[i])
            assert bpe.decode_ids(got, P.path(name)) == texts[i].encode()


def thue_morse():
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    return a, b


def test_pieces_with_one_fingerprint_keep_their_own_ids(monkeypatch):
    """Thue-Morse words, and a fingerprint that is the same for all pieces of the same length, or of any."""
    texts = [*thue_morse(), "one two six é ten", "", "ab cd", " ab", "É", *odd_texts(30)]
    known = library(FILES[0])

    def check():
        for first, last, ids, bounds, _, _ in bpe.encode_texts(texts, bpe.replay_table.__wrapped__(P.path(FILES[0]))):
            assert [x.tolist() for x in np.split(ids, bounds[1:-1])] == [known.encode_ordinary(t) for t in texts[first:last]]

    check()
    for names in (lambda p, s, e: (e - s).astype(np.uint64), lambda p, s, e: np.zeros(len(s), np.uint64)):
        monkeypatch.setattr(bpe, "ranges", names)
        check()


def test_the_corpus_table_holds_the_most_frequent_pieces(spark):
    texts = ["one two two two", "two one ten", "two 7 ten", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    counts = {bytes(r.piece): r.n for r in bpe.corpus_pieces(df).collect()}
    assert counts == {b"one": 1, b" two": 3, b"two": 2, b" one": 1, b" ten": 2, b" 7": 1}
    names, count, ids = bpe.corpus_table(df, P.path(FILES[0]), most=4)
    assert len(names) == 3 and len(ids) == count.sum() and (np.diff(names.astype(object)) > 0).all()
    assert len(bpe.corpus_table(df, P.path(FILES[0]), most=0)[0]) == 0
    known = library(FILES[0])
    table = bpe.PieceTable(lambda words: bpe.replay(words, bpe.merges(P.path(FILES[0]))), bpe.merges(P.path(FILES[0])), (names, count, ids))
    for _ in range(2):
        for first, last, found, bounds, _, _ in bpe.encode_texts([t or "" for t in texts], table):
            assert [x.tolist() for x in np.split(found, bounds[1:-1])] == [known.encode_ordinary(t or "") for t in texts]
    assert len(table.keys) == 3


def test_words_whose_order_of_merges_matters():
    vocabulary = bpe.merges(P.path(FILES[1]))
    rng = random.Random(2)
    words = [bytes(rng.choice(b"abcnst") for _ in range(rng.randint(1, 60))) for _ in range(500)]
    ids, counts = bpe.replay(words, vocabulary)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [bpe.merge_one(w, vocabulary) for w in words]


def test_query_round_trip_and_nulls(spark, tmp_path):
    texts = [*odd_texts(50), None, None]
    rows = [(i if i else None, t, "en") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, ids string").write.parquet(f"{tmp_path}/documents.parquet")
    e = library(FILES[0])
    expected = sorted((i or -1, *(lambda ids, t: (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))(e.encode_ordinary(t or ""), t or "")) for i, t, _ in rows)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op5_bpe(spark, str(tmp_path)).collect())
    assert got == expected


def test_ids_column(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r.ids for r in bpe.encode_documents(df, P.path(FILES[1])).collect()}
    assert rows == {1: library(FILES[1]).encode_ordinary("a b"), 2: []}
    assert bpe.encode_documents(df.limit(0), P.path(FILES[1])).count() == 0
