import random
import re

import numpy as np

from lodestone.llm import minhash


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def brute(docs):
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def compare(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = minhash.near_duplicates(df).collect()
    expected = brute(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == expected and len(rows) == len(expected)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_documents_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    compare(spark, docs)


def test_chains_copies_and_odd_texts(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    docs, words = [], list(base)
    for i in range(40):  # a chain: neighbours are similar, ends are not
        docs.append((1000 - i, " ".join(words)))
        at = rng.randrange(0, 280)
        words[at : at + 6] = [f"x{i}_{k}" for k in range(6)]
    docs += [(2000 + i, "  \t".join(base[:200])) for i in range(30)]
    docs += [(3000, ""), (3001, None), (3002, " \n "), (3003, "A b"), (3004, "a B"), (3005, "a  b c"), (3006, "É é"), (3007, "é é")]
    docs += [(4000 + i, " ".join(base[100:] + [f"y{i}"])) for i in range(30)]
    docs += [(5000, "la " * 100_000), (5001, "la " * 7), (5002, " ".join(f"v{i}" for i in range(50_000)))]
    compare(spark, docs)


def test_thue_morse_words_are_different(spark):
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    tail = " ".join(f"t{i}" for i in range(4))
    compare(spark, [(1, a), (2, b), (3, a + " " + tail), (4, b + " " + tail), (5, a)])


def test_a_document_has_one_text(spark):
    long = " ".join(f"w{i}" for i in range(40))
    docs = [(1, long), (1, "other words that are few here"), (2, long), (3, long + " x"), (3, long + " x"), (4, "other words that are few here"), (4, None)]
    rows = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert rows == {1: (2, 1), 2: (36, 2), 3: (37, 2), 4: (0, 4)}


def test_crowded_buckets(spark):
    """Texts that share a passage but aren't alike, near copies about the limit, and a hub's many members."""
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage, base = [word() for _ in range(60)], [word() for _ in range(150)]
    docs = [(i, " ".join([word() for _ in range(rng.randint(0, 40))] + passage[rng.randint(0, 8) :] + [word() for _ in range(rng.randint(0, 30))])) for i in range(250)]
    for i in range(300, 500):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(150)] = word()
        docs.append((i, " ".join(words)))
    compare(spark, docs)


def recall(pairs, seed):
    """The share of pairs of sets with a similarity of 100 / 140 that meet in a bucket."""
    rng, hits = np.random.default_rng(seed), 0
    for _ in range(pairs):
        x = rng.integers(1, 2**63, 140, np.uint64)
        sets, bounds = np.concatenate([np.sort(x[:120]), np.sort(x[20:])]), np.array([0, 120, 240])
        keys = minhash.half_keys(sets, bounds)
        hits += all((keys[0, side] == keys[1, side]).any() for side in (0, 1))
    return hits / pairs


def test_recall_of_the_tables_at_the_limit():
    assert recall(600, 1) > 0.9


def test_the_query_itself(spark, sf):
    found = minhash.op4_minhash(spark, sf)
    assert found.dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    expected = brute([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == expected


def test_repeated_null_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 1), (1, "a b c d e f", 2), (None, "a b c d e f", 3), (None, None, 4), (2, "a b c d e f", 5)], "doc_id long, text string, n long")
    rows = sorted(((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()), key=str)
    assert rows == [(0, 0, None, True), (0, 2, None, True), (1, 2, 1, True), (2, 2, 1, False)]
    assert minhash.near_duplicates(df.limit(0)).count() == 0
