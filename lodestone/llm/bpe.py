"""Byte-level BPE: splitting, merge replay over the corpus's distinct pieces, and decoding.

Texts are split by the GPT-2 pattern with array operations, so the work a text costs is a fingerprint for each piece.  The
pieces of the whole corpus are counted by a partial aggregation.  Those that occur often are dealt out and merged part by
part: an inverted index from token pair to the places where it stands is replayed in rank order over all pieces of a part
together, and each merge looks again only at the neighbours it touched.  Texts are then encoded by looking their pieces up
in the table so made.  The table is bounded, as every task holds it; pieces that occur too seldom to be in it are merged by
the same replay where they stand.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_batches, materialize, parallelism, read, release
from .textkit import LETTER, SPACE, chunks, classes, code_points, point_values, prefixes, ranges, slices, spread

#: Endings that follow an apostrophe as a piece of their own (fixed values, from the pattern).
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Pieces of the corpus's table, the most frequent ones; some 30 bytes each in every task.
TABLE_PIECES = 1_000_000
#: Distinct pieces a worker remembers between batches besides those of the table, or counts before it hands them on.
REMEMBERED = 400_000
#: Pieces that are replayed together.
PART_PIECES = 50_000
#: Counts above this are alike where the least count of a piece of the table is chosen.
MANY = 10_000
#: Rows whose new pieces are merged together.
REPLAYED = 4_000
_KEY = 1 << 20


def split_points(points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where pieces start, for texts laid one after another with the given bounds.

    The pattern: 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
    """
    n = len(points)
    kind = classes()[points]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    start = edge[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    # the last of the white space before a word stands alone, or joins the word if it is a plain space
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~edge[1:n]
    start |= last
    joined = np.flatnonzero(last & (points == 0x20)) + 1
    start[joined] = False
    # an apostrophe that begins a piece takes the ending behind it
    quote = np.flatnonzero((points == 0x27) & start)
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == LETTER) & ~edge[quote + 1]]
    if len(quote):
        padded = np.append(points, [0, 0]).astype(np.int64)
        one, two = padded[quote + 1], padded[quote + 2]
        two[edge[np.minimum(quote + 2, n)]] = 0
        took = np.zeros(len(quote), np.int64)
        for ending in CONTRACTIONS:
            fits = (one == ord(ending[0])) & (two == ord(ending[1]) if len(ending) == 2 else True) & (took == 0)
            took[fits] = len(ending)
        quote, took = quote[took > 0], took[took > 0]
        start[quote + 1] = False
        after = quote + 1 + took
        after = after[after < n]
        start[after] = True
    return np.flatnonzero(start)


class TokenBytes:
    """The bytes that ids stand for; ids may leave gaps."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        size = max(ranks.values()) + 1
        self.lengths = np.zeros(size, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self.bytes = np.zeros(self.offsets[-1], np.uint8)
        for token, rank in ranks.items():
            self.bytes[self.offsets[rank] : self.offsets[rank + 1]] = np.frombuffer(token, np.uint8)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bytes, and how many each id stands for."""
        count = self.lengths[ids]
        return self.bytes[spread(self.offsets[ids], count)], count


class Merges(TokenBytes):
    """A rank file's vocabulary: bytes by rank, and the rank of each pair that makes a token."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            super().__init__({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        keys, made = [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left * _KEY + right)
                    made.append(rank)
        order = np.argsort(keys)
        self.keys, self.made = np.array(keys, np.int64)[order], np.array(made, np.int64)[order]

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank that each pair merges to, or -1."""
        key = left * _KEY + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], -1)


@lru_cache(4)
def merges(path: str) -> Merges:
    return Merges(path)


def merge_one(word: bytes, vocabulary: Merges) -> list[int]:
    """One piece merged pair by pair with a heap: lowest rank first, leftmost of equals."""
    token = [int(x) for x in vocabulary.single[np.frombuffer(word, np.uint8)]]
    n = len(token)
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    ranks, text = vocabulary.ranks, [bytes([b]) for b in word]
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get(text[i] + text[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        if token[i] is None or after[i] < 0 or ranks.get(text[i] + text[after[i]]) != rank:
            continue
        j = after[i]
        text[i], token[i], token[j], after[i] = text[i] + text[j], rank, None, after[j]
        if after[i] >= 0:
            before[after[i]] = i
            if (r := ranks.get(text[i] + text[after[i]])) is not None:
                heapq.heappush(heap, (r, i))
        if before[i] >= 0 and (r := ranks.get(text[before[i]] + text[i])) is not None:
            heapq.heappush(heap, (r, before[i]))
    return [t for t in token if t is not None]


def replay(words: list[bytes], vocabulary: Merges) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words one after another, and how many each word has.

    Merges run over all words together in rank order.  Where one merge at several places of a word would open a pair
    of lower rank, the order within that word matters and it is merged alone.
    """
    data = np.frombuffer(b"".join(words), np.uint8)
    size = np.array([len(w) for w in words], np.int64)
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
    ends = np.cumsum(size)
    owner = np.repeat(np.arange(len(words)), size)
    token = vocabulary.single[data]
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[ends[size > 0] - 1] = -1
    before[(ends - size)[size > 0]] = -1
    pair = np.full(n, -1, np.int64)
    at = np.flatnonzero(after >= 0)
    pair[at] = vocabulary.pair_ranks(token[at], token[at + 1])
    alive = np.ones(n, bool)
    alone = np.zeros(len(words), bool)
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def enter(places: np.ndarray) -> None:
        ranks = pair[places]
        places, ranks = places[ranks >= 0], ranks[ranks >= 0]
        if not len(places):
            return
        if len(places) > 1:
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        first = 0
        for cut, rank in zip([*cuts.tolist(), len(ranks)], ranks[np.concatenate([[0], cuts])].tolist(), strict=True):
            if rank in index:
                index[rank].append(places[first:cut])
            else:
                index[rank] = [places[first:cut]]
                heapq.heappush(heap, rank)
            first = cut

    enter(at)
    while heap:
        rank = heapq.heappop(heap)
        lists = index.pop(rank)
        a = lists[0] if len(lists) == 1 else np.concatenate(lists)
        a = a[pair[a] == rank]
        if len(a) > 1:
            a = np.unique(a)
            chained = after[a[:-1]] == a[1:]
            if chained.any():
                k = np.arange(len(a))
                begin = np.maximum.accumulate(np.where(np.concatenate([[True], ~chained]), k, 0))
                a = a[(k - begin) % 2 == 0]
        if not len(a):
            continue
        b = after[a]
        c = after[b]
        token[a] = rank
        after[a] = c
        alive[b] = False
        pair[b] = -1
        inner = c >= 0
        before[c[inner]] = a[inner]
        pair[a] = -1
        x, y = a[inner], c[inner]
        pair[x] = vocabulary.pair_ranks(token[x], token[y])
        p = before[a]
        q = a[p >= 0]
        p = p[p >= 0]
        pair[p] = vocabulary.pair_ranks(token[p], token[q])
        touched = np.unique(np.concatenate([x, p])) if len(x) + len(p) > 1 else np.concatenate([x, p])
        if len(a) > 1:
            lower = touched[(pair[touched] >= 0) & (pair[touched] < rank)]
            if len(lower):
                word = owner[a]
                twice = word[1:][word[1:] == word[:-1]]
                alone[np.intersect1d(twice, owner[lower])] = True
        enter(touched)
    ids, counts = token[alive], np.bincount(owner[alive], minlength=len(words))
    if alone.any():
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for k in np.flatnonzero(alone):
            parts[k] = np.array(merge_one(words[k], vocabulary), np.int64)
        ids, counts = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
    return ids, counts


Table = tuple[np.ndarray, np.ndarray, np.ndarray]  # fingerprints in order, how many ids each has, and the ids


class PieceTable:
    """Ids of pieces, looked up by fingerprint: those of a table made before, and those a worker has met since, of which at
    most REMEMBERED stay between batches.

    encode gives the ids of pieces; tokens turns ids back into bytes, by which every look-up is checked.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], tokens: TokenBytes, table: Table | None = None):
        self.encode, self.tokens = encode, tokens
        none = np.zeros(0, np.int64)
        self.known, count, self.first = table if table is not None else (none.view(np.uint64), none, none)
        self.counts = count.astype(np.int64)
        self.clear()

    def clear(self) -> None:
        self.keys, self.order = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.count, self.ids = self.counts, self.first
        self.start = np.cumsum(self.count) - self.count

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, known)"""
        rows, found = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        for names, places in ((self.known, None), (self.keys, self.order)):
            if len(names):
                at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
                hit = (names[at] == keys) & ~found
                rows[hit] = at[hit] if places is None else places[at[hit]]
                found |= hit
        return rows, found

    def add(self, keys: np.ndarray, words: list[bytes]) -> None:
        ids, count = self.encode(words)
        places = np.arange(len(self.count), len(self.count) + len(keys))
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(count) - count])
        self.count, self.ids = np.concatenate([self.count, count]), np.concatenate([self.ids, ids.astype(self.ids.dtype)])
        keys, places = np.concatenate([self.keys, keys]), np.concatenate([self.order, places])
        order = np.argsort(keys)
        self.keys, self.order = keys[order], places[order]


def _by_bytes(text: str, start: np.ndarray, end: np.ndarray, table: PieceTable) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a text's pieces and how many each has, looked up by the pieces themselves."""
    words = [text[i:j].encode() for i, j in zip(start.tolist(), end.tolist(), strict=True)]
    place = {w: k for k, w in enumerate(dict.fromkeys(words))}
    ids, count = table.encode(list(place))
    rows = np.fromiter((place[w] for w in words), np.int64, len(words))
    return ids[spread((np.cumsum(count) - count)[rows], count[rows])], count[rows]


def _pieces(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(joined, start, codes, distinct, first, bounds): the texts as one, where pieces start in it, for each piece its place
    among the distinct fingerprints, these, the first piece of each, and where each text begins."""
    points, bounds = code_points(texts)
    if not len(points):
        none = np.zeros(0, np.int64)
        return "", none, none, none.view(np.uint64), none, bounds
    start = split_points(points, bounds)
    codes, distinct = pd.factorize(ranges(prefixes(point_values(points)), start, np.append(start[1:], len(points))))
    seen = np.maximum.accumulate(codes)
    return "".join(texts), start, codes, distinct, np.flatnonzero(np.concatenate([[True], seen[1:] > seen[:-1]])), bounds


def corpus_pieces(df: DataFrame, text: str = "text") -> DataFrame:
    """(piece, n): the distinct pieces of all texts and how often each occurs.

    A task adds up what it meets, REMEMBERED pieces at a time, so a piece that every text holds is few rows.
    """

    def handed(keys: list[np.ndarray], counts: list[np.ndarray], words: list[bytes]) -> Iterator[pa.RecordBatch]:
        _, first, inverse = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        n = np.bincount(inverse, np.concatenate(counts)).astype(np.int64)
        for low in range(0, len(first), 20_000):
            part = first[low : low + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array([words[k] for k in part.tolist()], pa.binary()), pa.array(n[low : low + 20_000])], ["piece", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, words = [], [], []
        for batch in slices(batches, REPLAYED):
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for first, last in chunks(np.array([len(t) for t in texts], np.int64)):
                joined, start, codes, distinct, new, _ = _pieces(texts[first:last])
                end = np.append(start[1:], len(joined))
                keys.append(distinct)
                counts.append(np.bincount(codes, minlength=len(distinct)))
                words += [joined[i:j].encode() for i, j in zip(start[new].tolist(), end[new].tolist(), strict=True)]
                if len(words) > REMEMBERED:
                    yield from handed(keys, counts, words)
                    keys, counts, words = [], [], []
        if words:
            yield from handed(keys, counts, words)

    return in_batches(df.select(text), run, "piece binary, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def corpus_table(df: DataFrame, path: str, text: str = "text", most: int = TABLE_PIECES) -> Table:
    """Ids of the corpus's most frequent pieces, at most so many: all that occur as often as some least number of times."""
    pieces = materialize(corpus_pieces(df, text), "pieces")
    rows = pieces.groupBy(F.least("n", F.lit(MANY)).alias("n")).agg(F.count("*").alias("c")).collect()  # at most MANY rows
    total, least = 0, MANY + 1
    for n, c in sorted(((r.n, r.c) for r in rows), reverse=True):
        if total + c > most:
            break
        total, least = total + c, n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[bytes] = []
        for batch in batches:
            words += batch.column(0).to_pylist()
            while len(words) >= PART_PIECES:
                yield replayed(words[:PART_PIECES])
                words = words[PART_PIECES:]
        if words:
            yield replayed(words)

    def replayed(words: list[bytes]) -> pa.RecordBatch:
        ids, count = replay(words, merges(path))
        points, bounds = code_points([w.decode() for w in words])
        names = ranges(prefixes(point_values(points)), bounds[:-1], bounds[1:])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(ids, pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), lists], ["name", "ids"])

    chosen = pieces.where(F.col("n") >= least).select("piece").repartition(parallelism(df.sparkSession), "piece")
    found = in_batches(chosen, run, "name long, ids array<int>").toArrow().combine_chunks()
    names = found.column("name").to_numpy().view(np.uint64)
    # of pieces with one fingerprint any may stand for it: look-ups are checked
    names, first = np.unique(names, return_index=True)
    lists = found.column("ids").combine_chunks().take(pa.array(first)) if len(names) else pa.array([], pa.list_(pa.int32()))
    release(pieces)
    return names, lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int32), lists.flatten().to_numpy(zero_copy_only=False)


def encode_texts(texts: list[str], table: PieceTable) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, last, ids, bounds, data, places) for groups of the texts: the ids one after another and each text's bounds,
    the bytes they decode to and each text's bounds there.

    Pieces are looked up by fingerprint.  The ids are decoded again: unless each piece's give its own bytes, which two
    pieces with one fingerprint would not, the group's pieces are looked up by their bytes.
    """
    if len(table.keys) > REMEMBERED:
        table.clear()
    parts, wanted = [], {}
    for first, last in chunks(np.array([len(t) for t in texts], np.int64)) if texts else ():
        joined, start, codes, distinct, new, bounds = _pieces(texts[first:last])
        end = np.append(start[1:], len(joined))
        for k in np.flatnonzero(~table.find(distinct)[1]):
            key = int(distinct[k])
            if key not in wanted:
                wanted[key] = joined[start[new[k]] : end[new[k]]].encode()
        parts.append((first, last, joined, start.astype(np.int32), codes.astype(np.int32), distinct, bounds))
    if wanted:
        table.add(np.fromiter(wanted, np.uint64, len(wanted)), list(wanted.values()))
    for first, last, joined, start, codes, distinct, bounds in parts:
        rows = table.find(distinct)[0][codes]
        count = table.count[rows]
        ids = table.ids[spread(table.start[rows], count)]
        pieces = np.searchsorted(start, bounds)
        raw = joined.encode()
        data, size = table.tokens.decode(ids)
        ends, places = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(size)])
        width = np.concatenate([[0], np.cumsum(_utf8_lengths(code_points([joined])[0]))]) if len(raw) != len(joined) else None
        begins = start if width is None else width[start]
        if len(data) != len(raw) or (places[ends[:-1]] != begins).any() or data.tobytes() != raw:
            ids, count = _by_bytes(joined, start, np.append(start[1:], len(joined)), table)
            data, size = table.tokens.decode(ids)
            ends, places = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(size)])
            assert data.tobytes() == raw
        yield first, last, ids, ends[pieces], data, places[ends[pieces]]


def _utf8_lengths(points: np.ndarray) -> np.ndarray:
    return 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)


@lru_cache(4)
def replay_table(path: str) -> PieceTable:
    """A table of nothing but what a worker meets."""
    vocabulary = merges(path)
    return PieceTable(lambda words: replay(words, vocabulary), vocabulary)


_held: dict[str, PieceTable] = {}


def shared_table(path: str, name: str, table: Broadcast) -> PieceTable:
    """The worker's table over a broadcast one of this name; of several the last stays."""
    if name not in _held:
        _held.clear()
        vocabulary = merges(path)
        _held[name] = PieceTable(lambda words: replay(words, vocabulary), vocabulary, table.value)
    return _held[name]


def encode_documents(df: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids): the ids of each text, null reading as empty.  Rows with equal or null ids are independent; texts are read
    whole, and no rows give no rows."""
    table, name = df.sparkSession.sparkContext.broadcast(corpus_table(df, path, text)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, REPLAYED):
            for first, last, ids, bounds, _, _ in encode_texts([t or "" for t in batch.column(1).to_pylist()], shared_table(path, name, table)):
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:last], lists], ["id", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return in_batches(df.select(id_col, text), run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode_ids(ids: np.ndarray, path: str) -> bytes:
    return merges(path).decode(np.asarray(ids, np.int64))[0].tobytes()


def encoded_digests(df: DataFrame, path: str) -> DataFrame:
    """The digests of what encode_documents gives and of its decoding, without shipping the ids themselves."""
    table, name = df.sparkSession.sparkContext.broadcast(corpus_table(df, path)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, REPLAYED):
            for first, last, ids, bounds, data, places in encode_texts([t or "" for t in batch.column(1).to_pylist()], shared_table(path, name, table)):
                raw, low = memoryview(ids.astype("<u4").tobytes()), bounds.tolist()
                text, at = memoryview(data.tobytes()), places.tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[first:last],
                        pa.array(np.diff(bounds), pa.int64()),
                        pa.array([hashlib.sha256(raw[4 * i : 4 * j]).hexdigest() for i, j in zip(low, low[1:], strict=False)]),
                        pa.array([hashlib.sha256(text[i:j]).hexdigest() for i, j in zip(at, at[1:], strict=False)]),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return in_batches(df.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encoded_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
