"""Best-fit packing planned on the histogram of lengths.

Only how many pieces have each length reaches the driver: at most max_len counts, whatever the input.  Best fit runs over
those counts, descending, and yields slots: ranges of ranks within a length that take consecutive sequences at one
offset.  A piece finds its slot by its rank within its length.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import PieceTable, TokenBytes, encode_texts
from .common import in_batches, materialize, read
from .textkit import slices

MAX_LEN = 1024
END_ID = 2


@lru_cache(4)
def _tokenizer(path: str):
    """The tokenizer of a tokenizers file, and a table of its ids for pieces.

    Its byte-level model splits by the same pattern as bpe.split_points, and a piece alone is one piece, so a text's ids
    are those of its pieces.  Distinct pieces go through the same vocabulary read as ranks, which gives the same ids only
    if merges are listed in the order of the ids they make; another file is refused.
    """
    import json

    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    letters = _byte_letters()
    back = {c: b for b, c in letters.items()}
    special = {t["content"]: t["id"] for t in said.get("added_tokens", ())}
    vocabulary = said["model"]["vocab"]
    made = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in said["model"]["merges"]]
    if said["model"]["type"] != "BPE" or made != sorted(set(made)):
        raise ValueError(f"{path}: not a BPE whose merges are in the order of their ids")
    ranks = {bytes(back[c] for c in token): i for token, i in vocabulary.items() if token not in special}
    core = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [core.encode_ordinary(w.decode()) for w in words]
        count = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for x in found for i in x), np.int64, int(count.sum())), count

    return PieceTable(encode, TokenBytes(ranks)), special


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def text_ids(texts: list[str], path: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, ids, bounds) of bpe.encode_texts with a tokenizers file; strings of its special tokens become their
    ids, as by default there."""
    table, special = _tokenizer(path)
    for first, last, ids, bounds, _, _ in encode_texts(texts, table):
        odd = [k for k in range(last - first) if any(s in texts[first + k] for s in special)]
        if odd:
            lists = np.split(ids, bounds[1:-1])
            for k in odd:
                lists[k] = _with_special(texts[first + k], table, special)
            ids, bounds = np.concatenate(lists), np.concatenate([[0], np.cumsum([len(x) for x in lists])])
        yield first, last, ids, bounds


def _with_special(text: str, table: PieceTable, special: dict[str, int]) -> np.ndarray:
    for token, number in special.items():
        if token in text:
            parts = [_with_special(p, table, special) for p in text.split(token)]
            return np.concatenate([x for p in parts for x in (np.array([number]), p)][1:])
    return next(encode_texts([text], table))[2]


def cut_pieces(df: DataFrame, path: str, max_len: int = MAX_LEN, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): a document's ids and end_id, cut from the back if over max_len."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names = batch.column(0)
            for first, last, ids, bounds in text_ids([t or "" for t in batch.column(1).to_pylist()], path):
                n = np.diff(bounds) + 1
                full = np.insert(ids, bounds[1:], end_id).astype("<u4").tobytes()
                base = np.concatenate([[0], np.cumsum(n)])[:-1]
                pieces = -(-n // max_len)
                doc = np.repeat(np.arange(len(n)), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                end = n[doc] - (pieces[doc] - 1 - piece) * max_len
                start = np.maximum(end - max_len, 0)
                view = memoryview(full)
                crc = [zlib.crc32(view[4 * i : 4 * j]) for i, j in zip((base[doc] + start).tolist(), (base[doc] + end).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [names[first:last].take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(end - start, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return in_batches(df.select("doc_id", "text"), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan_slots(counts: dict[int, int], max_len: int = MAX_LEN) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, offset) of best fit in descending order over counts of lengths.

    Open sequences are kept as ranges by the room they have left.  Pieces of one length fill the sequences with the
    least room that fits, each as often as it can, and then new ones.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    slots: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def put(length: int, rank: int, left: int, space: int, sequence: int, number: int) -> int:
        """Fills number sequences that have space left; returns how many pieces they took."""
        each = space // length
        whole, rest = divmod(min(left, number * each), each)
        for k in range(each):
            if take := whole + (k < rest):
                slots.append((length, rank, take, sequence, max_len - space + k * length))
                rank += take
        used = whole + (rest > 0)
        for first, n, held in ((sequence, whole, each), (sequence + whole, used - whole, rest), (sequence + used, number - used, 0)):
            if n and space > held * length:
                room.setdefault(space - held * length, []).append((first, n))
        return whole * each + rest

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        for space in sorted(s for s in room if s >= length):
            while left and room.get(space):
                sequence, number = room[space].pop()
                took = put(length, rank, left, space, sequence, number)
                rank, left = rank + took, left - took
                if left == 0:
                    break
            if not left:
                break
        if left:
            number = -(-left // (max_len // length))
            sequence, opened = opened, opened + number
            put(length, rank, left, max_len, sequence, number)
    return slots


def pack(pieces: DataFrame, max_len: int = MAX_LEN) -> DataFrame:
    """pieces with sequence_id and offset.

    The slots are broadcast: at most one for each length, room and place in it, so under max_len squared small rows
    whatever the number of pieces.  Ranks within a length come from groups of about the square root of its pieces, and the
    sums of the groups before: a task ranks one group, or adds up as many groups as a group has pieces.
    """
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    spark = pieces.sparkSession
    slots = spark.createDataFrame(plan_slots(counts, max_len), "length long, __from long, __ranks long, __sequence long, offset long")
    groups = spark.createDataFrame([(k, math.isqrt(n) + 1) for k, n in counts.items()], "length long, __groups long")
    dealt = pieces.join(F.broadcast(groups), "length").withColumn("__group", F.pmod(F.xxhash64("doc_id", "piece"), F.col("__groups"))).drop("__groups")
    before = Window.partitionBy("length").orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("length", "__group").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    within = Window.partitionBy("length", "__group").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("__rank", F.row_number().over(within) - 1).join(sums, ["length", "__group"]).withColumn("__rank", F.col("__rank") + F.col("__before"))
    placed = ranked.join(F.broadcast(slots), "length").where((F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__from") + F.col("__ranks")))
    return placed.withColumn("sequence_id", F.col("__sequence") + F.col("__rank") - F.col("__from")).select(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, max_len: int = MAX_LEN) -> DataFrame:
    """Pieces of the documents with their places in sequences of at most max_len ids.

    A null or empty text is one piece of the end id.  Rows with equal or null doc_ids are packed independently.
    """
    return pack(materialize(cut_pieces(docs, path, max_len), "pieces"), max_len)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
