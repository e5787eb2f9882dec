"""Repeated passages: bytes covered by a LENGTH-byte string that also starts earlier.

Places are sorted by Spark, at a growing length, as prefix doubling does, and go on to the next length only while their
name is shared; three things differ from the textbook.  The first length, FIRST bytes, is looked at only where a minimiser
of the windows stands: equal windows have equal minimisers, so equal windows are looked at in equal places and about one
place in (LENGTH - FIRST) / 2 is sorted.  Windows that share a minimiser are a stretch.  Names are fingerprints of the
bytes, made where the text lies, instead of dense ranks that a sort hands back to every place.  And the second name of a
place is that of all it must be equal in, not that of the next FIRST bytes.  Spark sorts

  1. (name of FIRST bytes, name of the whole stretch): of equal stretches all but the earliest are repeats as a whole; a
     stretch goes on if another one shares its first name but not its second;
  2. the names of LENGTH bytes of each window of those that go on: all but the earliest are repeats.

Names that decide a removal have 93 bits (two residues and a third one, see textkit), so 3e12 of them, which is 100 TB of
text, hold a false pair with a chance of under 0.1 %.  Each task first reduces its own repeats, so a passage that a third of all documents share is
one row for some hundred documents.  Rows cross the network packed, many to a bucket, and are unpacked and sorted by the JVM,
which spills; workers read them in order, so no task holds a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches, materialize, parallelism, read, release
from .textkit import U, byte_values, checks, mix, prefixes, ranges, slices, spread, utf8_chunks

LENGTH = 100
FIRST = 32
_WINDOW = LENGTH - FIRST + 1
#: Buckets for each shuffle partition.
SPLIT = 4
REPEAT, SHARED = 0, 1


def minimisers(names: np.ndarray) -> np.ndarray:
    """For each window of _WINDOW names the place of the least, the leftmost of equals."""
    n, size, least = len(names), 1, names
    place = np.arange(len(names), dtype=np.int32)
    while size < _WINDOW:
        step = min(size, _WINDOW - size)
        right = least[step:] < least[: len(least) - step]
        place = np.where(right, place[step:], place[: len(place) - step])
        least = np.where(right, least[step:], least[: len(least) - step])
        size += step
    assert len(place) == n - _WINDOW + 1
    return place


def stretches(data: np.ndarray, offsets: np.ndarray):
    """(document, first window, last window, name of FIRST bytes, name and check of the stretch) of all texts' stretches."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none.view(U), none.view(U), none.astype(np.int32)
    prefix = prefixes(byte_values(data, 3))
    starts = np.arange(len(data) - FIRST + 1)
    names = ranges(prefix, starts, starts + FIRST)
    place = minimisers(names)
    sizes = np.diff(offsets)
    doc = np.repeat(np.arange(len(sizes)), sizes)[: len(place)]
    inside = np.arange(len(place)) + LENGTH <= offsets[1:][doc]
    change = np.ones(len(place), bool)
    change[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(change)
    last = np.append(first[1:], len(place)) - 1
    keep = inside[first]
    first, last = first[keep], last[keep]
    whole = ranges(prefix, first, last + LENGTH)
    # the minimiser's place in the stretch belongs to its name
    whole = mix(whole + (place[first] - first).astype(U) * U(0x9E3779B97F4A7C15))
    return doc[first], first - offsets[:-1][doc[first]], last - offsets[:-1][doc[first]], names[place[first]], whole, checks(prefix, first, last + LENGTH)


def merged(start: np.ndarray, end: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, end) of the unions of touching spans of each document."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    base = int(end.max()) + 2
    place = np.unique(doc, return_inverse=True)[1]
    reach = np.maximum.accumulate(end + place * base) - place * base
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])
    at = np.flatnonzero(new)
    return doc[at], start[at], reach[np.append(at[1:], len(doc)) - 1]


def _packed(columns: dict[str, np.ndarray], bucket: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket, with its values as arrays."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    cuts = np.concatenate([[0], cuts, [len(bucket)]]) if len(bucket) else np.zeros(1, np.int64)
    lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values[order])) for values in columns.values()]
    return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]].astype(np.int32)), *lists], ["bucket", *columns])


_STRETCH = {"name": "bigint", "whole": "bigint", "check": "int", "doc": "bigint", "first": "int", "count": "int"}
_WINDOWS = {"name": "bigint", "check": "int", "doc": "bigint", "first": "int", "count": "int"}
_SPANS = "doc_id long, kind int, first int, last int"


def _schema(kinds: dict[str, str]) -> str:
    return ", ".join(["bucket int", *(f"{k} array<{t}>" for k, t in kinds.items())])


def _ordered(rows: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """The packed rows dealt out by bucket, unpacked and sorted within each task; every value is one column, in order."""
    dealt = rows.repartition(parallelism(rows.sparkSession), "bucket")
    flat = dealt.select(F.explode(F.arrays_zip(*kinds)).alias("x")).select("x.*")
    return flat.sortWithinPartitions(*kinds)


def _columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {k: batch.column(k).to_numpy(zero_copy_only=False) for k in batch.schema.names}


def _new(names: tuple[np.ndarray, ...], before: tuple | None) -> np.ndarray:
    """Where a row's names differ from the row's before it; before has those of the row before the first."""
    out = np.ones(len(names[0]), bool)
    out[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in names])
    out[0] = before is None or any(x[0] != y for x, y in zip(names, before, strict=True))
    return out


def _earliest(names: tuple[np.ndarray, ...], doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, head): rows sorted by names, document and place, and which of them are their names' earliest."""
    order = np.lexsort((place, doc, *names))
    return order, _new(tuple(x[order] for x in names), None) if len(order) else np.zeros(0, bool)


def _spans(doc: np.ndarray, kind: int, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc.astype(np.int64)), pa.array(np.full(len(doc), kind, np.int32)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], ["doc_id", "kind", "first", "last"])


def _with_done(columns: dict[str, np.ndarray], doc: np.ndarray, start: np.ndarray, end: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Packed rows of columns, and of spans that are repeats already: these pass through with a count below 0."""
    n = len(doc)
    done = {"doc": doc, "first": start, "count": start - end}
    route = np.concatenate([columns["name"].view(U), mix(doc.astype(U))]) % U(buckets)
    return _packed({k: np.concatenate([v, done.get(k, np.zeros(n, np.int64))]).astype(v.dtype) for k, v in columns.items()}, route.astype(np.int64))


def stretch_rows(docs: DataFrame, buckets: int) -> DataFrame:
    """All stretches, packed by bucket of their first name; of those that repeat in a group of texts only the earliest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for low, high, data, offsets in utf8_chunks(batch.column(1)):
                doc, first, last, name, whole, check = stretches(data, offsets)
                doc = ids[low:high][doc].astype(np.int64)
                order, head = _earliest((check, whole), doc, first)
                later, keep = order[~head], order[head]
                columns = {"name": name[keep].view(np.int64), "whole": whole[keep].view(np.int64), "check": check[keep], "doc": doc[keep], "first": first[keep].astype(np.int32), "count": (last[keep] - first[keep] + 1).astype(np.int32)}
                yield _with_done(columns, *merged(first[later], last[later] + 1, doc[later]), buckets)

    return in_batches(docs, run, _schema(_STRETCH))


def judged_stretches(rows: DataFrame) -> DataFrame:
    """(doc_id, kind, first, last): windows that repeat, and stretches whose windows must be looked at one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, held = None, None  # the names of the last row; the only head so far of its first name
        for batch in batches:
            x = _columns(batch)
            done = x["count"] < 0
            if done.any():
                yield _spans(x["doc"][done], REPEAT, x["first"][done], x["first"][done] - x["count"][done] - 1)
                x = {k: v[~done] for k, v in x.items()}
            n = len(x["name"])
            if not n:
                continue
            names = (x["name"], x["whole"], x["check"])
            head = _new(names, before)
            last = x["first"] + x["count"] - 1
            yield _spans(x["doc"][~head], REPEAT, x["first"][~head], last[~head])
            heads = np.flatnonzero(head)
            if len(heads):
                name = x["name"][heads]
                opens = np.ones(len(heads), bool)  # the first head of its name
                opens[1:] = name[1:] != name[:-1]
                opens[0] = before is None or name[0] != before[0]
                joined = np.ones(len(heads), bool)  # shares its name with the head before or behind it
                joined[:-1] = ~opens[:-1] | ~opens[1:]
                joined[-1] = not opens[-1]
                if not opens[0] and held:
                    yield _spans(*(np.array([v]) if k != 1 else v for k, v in enumerate(held)))
                shared = heads[joined]
                yield _spans(x["doc"][shared], SHARED, x["first"][shared], last[shared])
                k = heads[-1]
                held = (x["doc"][k], SHARED, x["first"][k], last[k]) if opens[-1] else None
            before = tuple(v[-1] for v in names)

    return in_batches(_ordered(rows, _STRETCH), run, _SPANS)


def window_rows(shared: DataFrame, buckets: int) -> DataFrame:
    """The windows of the stretches (doc_id, text, spans), named by all their bytes and packed; as stretch_rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(2)
            span_of = np.asarray(lists.offsets) - np.asarray(lists.offsets)[0]
            values = lists.flatten()
            firsts, lasts = values.field("first").to_numpy(zero_copy_only=False), values.field("last").to_numpy(zero_copy_only=False)
            for low, high, data, offsets in utf8_chunks(batch.column(1)):
                prefix = prefixes(byte_values(data, 3))
                a, b = span_of[low], span_of[high]
                owner = np.repeat(np.arange(high - low), np.diff(span_of[low : high + 1]))
                count = (lasts[a:b] - firsts[a:b] + 1).astype(np.int64)
                place = spread(firsts[a:b].astype(np.int64), count)
                owner = np.repeat(owner, count)
                start = place + offsets[:-1][owner]
                name, check, doc = ranges(prefix, start, start + LENGTH), checks(prefix, start, start + LENGTH), ids[low:high][owner].astype(np.int64)
                order, head = _earliest((check, name), doc, place)
                later, keep = order[~head], order[head]
                columns = {"name": name[keep].view(np.int64), "check": check[keep], "doc": doc[keep], "first": place[keep].astype(np.int32), "count": np.ones(len(keep), np.int32)}
                yield _with_done(columns, *merged(place[later], place[later] + 1, doc[later]), buckets)

    return in_batches(shared, run, _schema(_WINDOWS))


def judged_windows(rows: DataFrame) -> DataFrame:
    """(doc_id, kind, first, last) of the windows that repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            x = _columns(batch)
            done = x["count"] < 0
            if done.any():
                yield _spans(x["doc"][done], REPEAT, x["first"][done], x["first"][done] - x["count"][done] - 1)
                x = {k: v[~done] for k, v in x.items()}
            if not len(x["name"]):
                continue
            names = (x["name"], x["check"])
            head = _new(names, before)
            d, s, e = merged(x["first"][~head].astype(np.int64), x["first"][~head].astype(np.int64) + 1, x["doc"][~head])
            yield _spans(d, REPEAT, s, e - 1)
            before = tuple(v[-1] for v in names)

    return in_batches(_ordered(rows, _WINDOWS), run, _SPANS)


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, first, last): ranges of places where LENGTH-byte strings start that also start earlier."""
    buckets = SPLIT * parallelism(docs.sparkSession)
    known = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    found = materialize(judged_stretches(stretch_rows(known, buckets)), "stretches")
    shared = found.where(f"kind = {SHARED}").groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    looked = known.join(shared, "doc_id").select("doc_id", "text", "spans")
    windows = materialize(judged_windows(window_rows(looked, buckets)), "windows")
    return found.union(windows).where(f"kind = {REPEAT}").select("doc_id", "first", "last")


def doubled_windows(docs: DataFrame) -> DataFrame:
    """repeated_windows() by textbook prefix doubling: every place of every text, ranks without fingerprints.

    Spark sorts (rank, rank at the offset) pairs and ranks them anew at lengths of 8, 16, 32 and 64 bytes; places whose rank
    no other place has leave at each.  A string of LENGTH bytes is its first and its last 64.  Each round joins and sorts a
    row for each place that is left, which no disk budget allows for a corpus (the README has figures): it is here to hold
    the other way against.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for low, high, data, offsets in utf8_chunks(batch.column(1)):
                if len(data) < 8:
                    continue
                names = np.lib.stride_tricks.sliding_window_view(data, 8).copy().view(">i8").ravel().astype(np.int64)
                owner = np.repeat(np.arange(high - low), np.diff(offsets))[: len(names)]
                place = np.arange(len(names)) - offsets[:-1][owner]
                keep = (place + 8 <= np.diff(offsets)[owner]) & (np.diff(offsets)[owner] >= LENGTH)
                yield pa.RecordBatch.from_arrays([pa.array(ids[low:high][owner[keep]]), pa.array(place[keep].astype(np.int32)), pa.array(names[keep])], ["doc_id", "place", "rank"])

    known = docs.where("doc_id is not null and text is not null").select("doc_id", "text").distinct()
    left = materialize(in_batches(known, first, "doc_id long, place int, rank long"), "places")
    for offset in (8, 16, 32, LENGTH - 64):
        behind = left.select("doc_id", (F.col("place") - offset).alias("place"), F.col("rank").alias("next"))
        pairs = materialize(left.join(behind, ["doc_id", "place"]), "rank-pairs")
        shared = pairs.groupBy("rank", "next").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "place")).alias("earliest")).where("c > 1")
        ranked = shared.repartitionByRange("rank", "next").sortWithinPartitions("rank", "next").withColumn("new", F.monotonically_increasing_id())
        found = pairs.join(ranked.select("rank", "next", "new", "earliest"), ["rank", "next"])
        if offset == LENGTH - 64:
            later = found.where(F.struct("doc_id", "place") != F.col("earliest"))
            return later.select("doc_id", F.col("place").alias("first"), F.col("place").alias("last"))
        release(left)
        left = materialize(found.select("doc_id", "place", F.col("new").alias("rank")), "places")
        release(pairs)
    raise AssertionError("unreachable")


def cut(docs: DataFrame, repeats: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns carry with n_bytes, n_removed, n_spans, kept and left: texts without the bytes that repeats cover.

    kept is binary; left is the same as text, without what a cut may leave of a character.
    """
    spans = repeats.groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    joined = docs.join(spans, "doc_id", "left").select(F.struct(*carry).alias("carried"), "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lists = batch.column("spans")
            for low, high, data, offsets in utf8_chunks(batch.column("text")):
                # 1 where a span begins and -1 behind its end; bytes are kept where the sum is 0
                part = lists[low:high]
                count = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                values = part.flatten()
                depth = np.zeros(len(data) + 1, np.int32)
                base = np.repeat(offsets[:-1], count)
                np.add.at(depth, base + values.field("first").to_numpy(zero_copy_only=False), 1)
                np.add.at(depth, base + values.field("last").to_numpy(zero_copy_only=False) + LENGTH, -1)
                keep = np.cumsum(depth[:-1]) == 0
                gone = ~keep
                begins = gone.copy()
                begins[1:] &= keep[:-1]
                inner = offsets[:-1][np.diff(offsets) > 0]
                begins[inner] = gone[inner]
                sums = np.concatenate([[0], np.cumsum(keep)])
                left, bounds = data[keep], sums[offsets]
                runs = np.concatenate([[0], np.cumsum(begins)])[offsets]
                size = np.diff(offsets)
                raw = pa.Array.from_buffers(pa.binary(), high - low, [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(left.tobytes())])
                text = pa.array([x.as_py().decode("utf-8", "ignore") for x in raw])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("carried")[low:high], pa.array(size), pa.array(size - np.diff(bounds)), pa.array(np.diff(runs)), raw, text],
                    ["carried", "n_bytes", "n_removed", "n_spans", "kept", "left"],
                )

    made = T._parse_datatype_string("n_bytes long, n_removed long, n_spans long, kept binary, left string")
    found = in_batches(joined, run, T.StructType([joined.schema["carried"], *made.fields]))
    return found.select("carried.*", *made.fieldNames())


def remove_repeats(docs: DataFrame) -> DataFrame:
    """cut() of docs (doc_id, text) by their own repeats.

    Null texts read as empty.  Texts under LENGTH bytes lose nothing.  Rows with a null doc_id lose nothing and don't
    count as earlier.  Rows that share a doc_id count as copies of one document: equal ones lose the same bytes.  Ties
    (equal strings at one place) lose nothing more.  One text, however long, is read by one task, with some 40 bytes a byte
    of it; no table gives no rows.
    """
    return cut(docs.select("doc_id", "text"), repeated_windows(docs))


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
