import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from lodestone.llm import packing
from test_bpe import odd_texts, thue_morse

PATH = P.path("byte_bpe_50k.json")


def best_fit(lengths, size):
    """Best fit, descending, one piece at a time."""
    room = []
    for length in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= length]
        if fits:
            k = min(fits, key=lambda i: room[i])
            room[k] -= length
        else:
            room.append(size - length)
    return len(room)


def test_plan_places_every_rank_once_without_gaps_as_best_fit_does():
    rng = random.Random(3)
    for _ in range(200):
        counts = {rng.randint(1, 64): rng.randint(1, 50) for _ in range(rng.randint(1, 30))}
        taken, filled = set(), defaultdict(list)
        for length, rank, n, sequence, offset in packing.plan_slots(counts, 64):
            for j in range(n):
                assert (length, rank + j) not in taken
                taken.add((length, rank + j))
                filled[sequence + j].append((offset, length))
        assert taken == {(k, i) for k, n in counts.items() for i in range(n)}
        for places in filled.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= 64
        assert len(filled) == best_fit([k for k, n in counts.items() for _ in range(n)], 64)


def test_pieces_equal_the_library_and_pack_tightly(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = [*odd_texts(60), "a<|endoftext|> b", "<|endoftext|><|endoftext|>", None, "x y " * 9000, *thue_morse()]
    extra = [(10**6 + i, t) for i, t in enumerate(extra)]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    rows = packing.pack_documents(docs, PATH).collect()
    tokenizer = Tokenizer.from_file(PATH)
    found, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        found[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        sequences[r.sequence_id].append((r.offset, r.length))
    lengths = []
    for d in docs.collect():
        ids = [*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        expected = [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        assert sorted(found[d.doc_id]) == expected
        lengths += [x[2] for x in expected]
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) == best_fit(lengths, 1024)


def test_repeated_rows_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a", 5), (1, "a", 5), (None, None, 5)], "doc_id long, text string, length int")
    rows = packing.pack_documents(docs, PATH).collect()
    assert Counter((r.doc_id, r.length) for r in rows) == {(1, 2): 2, (None, 1): 1}
    assert sorted(r.offset for r in rows) == [0, 2, 4] and {r.sequence_id for r in rows} == {0}
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0


def test_the_query_itself(spark, sf):
    found = packing.op9_packing(spark, sf)
    assert found.dtypes == [("doc_id", "bigint"), ("piece", "int"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint")]
    rows = found.collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_a_vocabulary_in_another_order_is_refused(tmp_path):
    import json

    import pytest

    said = json.load(open(PATH, encoding="utf-8"))
    said["model"]["merges"] = said["model"]["merges"][::-1]
    (tmp_path / "t.json").write_text(json.dumps(said))
    with pytest.raises(ValueError):
        packing._tokenizer(str(tmp_path / "t.json"))
