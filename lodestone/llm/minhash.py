"""Near-duplicate documents by MinHash with tensored banding, confirmed on whole shingle sets.

A document has TABLES keys in each of two collections, each key made of ROWS minimum hashes.  Every pair of a key from one
and a key from the other is the key of a table, so TABLES**2 tables cost only 2 * TABLES * ROWS minimum hashes.  A pair of
similarity s shares a bucket with probability (1 - (1 - s**ROWS)**TABLES)**2: 0.991 at 0.75, 0.22 at 0.5, 0.002 at 0.3.

Documents with equal sets are one class from the start.  In each bucket all classes are compared with its least class.
Keys whose buckets still hold several components are looked at again: a shingle that no other such document has can't be shared,
so a document most of whose set is its own links with nothing; of the rest, those outside a key's largest component are
compared with all that have the key, in blocks, each against an inverted index of the other.  So no bucket is capped and
none emits its pairs: a task returns the edges of a forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_batches, materialize, parallelism, read, release
from .graph import components, forest
from .textkit import byte_values, mix, prefixes, ranges, runs, segment, slices, utf8_chunks
from .vectors import meet

SHINGLE = 5
#: Documents are linked with PERCENT * union <= 100 * intersection of their sets.
PERCENT = 75
TABLES, ROWS = 20, 5
#: Members that are compared with one copy of their hub's text, and rows of the blocks compared with one another.
HUB_ROWS, BLOCK_ROWS = 256, 256
#: Ids that are broadcast at most; more are joined by a shuffle.
MAX_BROADCAST_IDS = 1_000_000

_rng = np.random.default_rng(20240229)
_STEPS = _rng.integers(1, 2**63, SHINGLE + 1, np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = _rng.integers(1, 2**31, (2, TABLES, ROWS), np.uint32) * np.uint32(2) + np.uint32(1)
_MASKS = _rng.integers(0, 2**32, (2, TABLES, ROWS), np.uint32)
_SIGNS = _rng.integers(0, 2**63, 2, np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEPARATES = np.zeros(256, bool)
_SEPARATES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of UTF-8 texts laid one after another, sorted within each text, and each text's bounds."""
    low = _LOWER[data]
    start, end = runs(~_SEPARATES[low], offsets)
    words = ranges(prefixes(byte_values(low)), start, end)
    first = np.searchsorted(start, offsets)
    count = np.diff(first)
    doc = np.repeat(np.arange(len(count)), count)
    left = np.repeat(first[1:], count) - np.arange(len(words))
    short = np.repeat(count < SHINGLE, count)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(words), np.uint64)
        for j in range(SHINGLE):
            inside = left > j
            sums[inside] += words[np.flatnonzero(inside) + j] * _STEPS[j]
        begins = np.repeat(first[:-1], count) == np.arange(len(words))
        keep = np.where(short, begins, left >= SHINGLE)
        sums = mix(sums[keep] + np.minimum(np.repeat(count, count), SHINGLE)[keep].astype(np.uint64) * _STEPS[SHINGLE])
    doc = doc[keep]
    # sorted by document and the high bits of the shingle; only if these tie between different shingles by all its bits
    near = (doc.astype(np.uint64) << np.uint64(44)) | (sums >> np.uint64(20))
    order = np.argsort(near, kind="stable")
    near, sums_, doc_ = near[order], sums[order], doc[order]
    if len(count) >= 1 << 20 or ((near[1:] == near[:-1]) & (sums_[1:] != sums_[:-1])).any():
        order = np.lexsort((sums, doc))
        sums_, doc_ = sums[order], doc[order]
    new = np.ones(len(sums_), bool)
    new[1:] = (sums_[1:] != sums_[:-1]) | (doc_[1:] != doc_[:-1])
    return sums_[new], np.searchsorted(doc_[new], np.arange(len(count) + 1))


def set_signs(sets: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that are equal for equal sets."""
    with np.errstate(over="ignore"):
        return tuple(segment(np.add, mix(sets ^ s), bounds, 0).view(np.int64) for s in _SIGNS)


def half_keys(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """texts x 2 x TABLES: the keys of both collections, each from ROWS minimum hashes; 0 for empty sets."""
    out = np.zeros((len(bounds) - 1, 2, TABLES), np.uint64)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        high, begins = (sets >> np.uint64(32)).astype(np.uint32), bounds[:-1][full]
        values = np.empty_like(high)
        with np.errstate(over="ignore"):
            for side in range(2):
                for table in range(TABLES):
                    key = np.full(len(full), side * TABLES + table + 1, np.uint64)
                    for row in range(ROWS):
                        np.bitwise_xor(high, _MASKS[side, table, row], out=values)
                        np.multiply(values, _FACTORS[side, table, row], out=values)
                        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(values, begins))
                    out[full, side, table] = key
    return out.view(np.int64)


def sketch(df: DataFrame) -> DataFrame:
    """(doc_id, n, s1, s2, keys) for the rows of df (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for first, last, data, offsets in utf8_chunks(batch.column(1)):
                sets, bounds = shingle_sets(data, offsets)
                one, two = set_signs(sets, bounds)
                keys = half_keys(sets, bounds).reshape(-1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(last - first + 1) * 2 * TABLES, pa.int32()), pa.array(keys))
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:last], pa.array(np.diff(bounds)), pa.array(one), pa.array(two), lists], ["doc_id", "n", "s1", "s2", "keys"])

    return in_batches(df.select("doc_id", "text"), run, "doc_id long, n long, s1 long, s2 long, keys array<long>")


def set_arrays(texts: DataFrame) -> DataFrame:
    """(doc_id, set) for texts (doc_id, text, n, s1, s2): the sets as arrays, of those rows whose set has these signs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            wanted = [batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3, 4)]
            for first, last, data, offsets in utf8_chunks(batch.column(1)):
                sets, bounds = shingle_sets(data, offsets)
                fits = np.logical_and.reduce([x[first:last] == y for x, y in zip(wanted, (np.diff(bounds), *set_signs(sets, bounds)), strict=True)])
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(sets.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:last], lists], ["doc_id", "set"]).filter(pa.array(fits))

    return in_batches(texts.select("doc_id", "text", "n", "s1", "s2"), run, "doc_id long, set array<long>")


def similar(both: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of n and of m shingles that have so many in common are linked."""
    return (both > 0) & (100 * both >= PERCENT * (n + m - both))


def linked_to_hubs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (hub, rep) whose whole sets are similar enough, as (u, v).

    A hub's set goes once to every HUB_ROWS of its members, not once to each, and members of one hub to many tasks.
    """
    salts = materialize(pairs.groupBy("hub").agg(F.ceil(F.count("*") / HUB_ROWS).cast("int").alias("salts")), "salts")
    hubs = salts.join(sets.withColumnRenamed("doc_id", "hub"), "hub").select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("rep"), "set")
    dealt = pairs.join(_small(salts), "hub").withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int"))
    members = dealt.join(sets.withColumnRenamed("doc_id", "rep"), "rep").select("hub", "salt", "rep", "set")
    rows = hubs.union(members).repartition(parallelism(sets.sparkSession), "hub", "salt").sortWithinPartitions("hub", "salt", F.col("rep").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.int64)
        for batch in slices(batches):
            hub, rep, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2), batch.column(3)
            opens = rep.is_null().to_numpy(zero_copy_only=False)
            rep = rep.fill_null(0).to_numpy(zero_copy_only=False)
            shingles, bounds = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            cuts = sorted({0, len(rep), *np.flatnonzero(opens).tolist()})
            for low, high in zip(cuts, cuts[1:], strict=False):
                if opens[low]:
                    held = np.sort(shingles[bounds[low] : bounds[low + 1]])
                    low += 1
                if low < high and len(held):
                    part = shingles[bounds[low] : bounds[high]]
                    found = held[np.minimum(np.searchsorted(held, part), len(held) - 1)] == part
                    both = segment(np.add, found.astype(np.int64), bounds[low : high + 1] - bounds[low], 0)
                    keep = low + np.flatnonzero(similar(both, np.diff(bounds[low : high + 1]), len(held)))
                    yield pa.RecordBatch.from_arrays([pa.array(hub[keep]), pa.array(rep[keep])], ["u", "v"])

    return in_batches(rows, run, "u long, v long")


def _linked_in_block(held: pa.Table, asked: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The edges of a forest of the links between the rows of asked and those of held in another component."""

    def read_sets(table) -> tuple[np.ndarray, ...]:
        sets = table.column("set")
        sets = sets.combine_chunks() if isinstance(sets, pa.ChunkedArray) else sets
        ids, components_ = (table.column(c).to_numpy() if isinstance(table, pa.Table) else table.column(c).to_numpy(zero_copy_only=False) for c in ("id", "component"))
        return ids, components_, sets.flatten().to_numpy(zero_copy_only=False), sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)

    ids, group, shingles, n = read_sets(held)
    names, other, asked_shingles, m = read_sets(asked)
    order = np.argsort(shingles, kind="stable")
    shingles, owner = shingles[order], np.repeat(np.arange(len(ids)), n)[order]
    low, high = np.searchsorted(shingles, asked_shingles, "left"), np.searchsorted(shingles, asked_shingles, "right")
    ends = np.concatenate([[0], np.cumsum(m)])
    found = []
    for k in range(len(names)):
        a, b = low[ends[k] : ends[k + 1]], high[ends[k] : ends[k + 1]]
        both = np.bincount(np.concatenate([owner[x:y] for x, y in zip(a[b > a].tolist(), b[b > a].tolist(), strict=True)] or [np.zeros(0, np.int64)]), minlength=len(ids))
        links = np.flatnonzero(similar(both, n, m[k]) & (group != other[k]))
        found.append((np.full(len(links), names[k]), ids[links]))
    u, v = (np.concatenate([f[side] for f in found]) for side in (0, 1))
    if len(u):
        u, v = forest(u, v)
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def still_apart(sets: DataFrame) -> DataFrame:
    """Those rows of sets (id, component, keys, n, set) that can link with another one by what they share with any."""
    shingles = sets.select("id", F.explode("set").alias("shingle"))
    common = shingles.groupBy("shingle").agg(F.count("*").alias("c")).where("c > 1").select("shingle")
    core = shingles.join(common, "shingle", "left_semi").groupBy("id").agg(F.count("*").alias("core"))
    # a set is like another one only if their common part is PERCENT of it at least
    return sets.join(core, "id").where(f"100 * core >= {PERCENT} * n").drop("core")


def linked_in_buckets(rest: DataFrame) -> DataFrame:
    """(u, v): edges that connect what links connect among rows (id, component, keys, set) that share a key."""
    placed = rest.select(F.explode("keys").alias("key"), "id", "component", "set")
    sizes = placed.groupBy("key", "component").agg(F.count("*").alias("c"))
    main = sizes.groupBy("key").agg(F.max(F.struct("c", "component")).alias("main"), F.count("*").alias("several")).where("several > 1").select("key", "main.component")
    # where few keys hold several components, the members of a common one aren't gathered in one task
    members = placed.join(_small(materialize(main.withColumnRenamed("component", "main"), "mixed-keys")), "key")
    asked = members.where("component != main").drop("main")
    return meet(members.drop("main"), asked, "key", BLOCK_ROWS, BLOCK_ROWS, _linked_in_block, "u long, v long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for docs (doc_id, text), one row for each doc_id.

    Texts without words, null ones included, have empty sets and link with nothing.  Rows that share a doc_id are one
    document; of different texts the one with the fewest shingles counts.  A null doc_id links with nothing either: each
    such row comes back with a null component_id, and kept.  The least doc_id names a component, so ties can't arise.  A
    text, however long, is one row of one task at a time; no table gives no rows.
    """
    sketches = materialize(sketch(docs), "sketches")
    known = sketches.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("n", "s1", "s2")).alias("s")).select("doc_id", "s.*")
    known = materialize(known, "known")
    classes = materialize(known.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep")), "classes")
    heads = sketches.join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", "n", "s1", "s2"]).select(F.col("doc_id").alias("rep"), "n", "keys").dropDuplicates(["rep"])

    # a key that no other class has can't meet anyone, and neither can a document without a shared key on both sides
    every = heads.select("rep", "n", F.posexplode("keys").alias("at", "key"))
    shared = every.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    side = {k: F.filter("keys", lambda x: x["side"] == k) for k in (0, 1)}
    place = every.join(shared, "key", "left_semi").groupBy("rep", "n").agg(F.collect_list(F.struct((F.col("at") >= TABLES).cast("int").alias("side"), "key")).alias("keys"))
    tables = place.select("rep", "n", F.explode(side[0]["key"]).alias("a"), side[1]["key"].alias("bs")).select("rep", "n", "a", F.explode("bs").alias("b"))
    tables = materialize(tables.select(F.xxhash64("a", "b").alias("bucket"), "rep", "n", "a"), "tables")
    buckets = tables.groupBy("bucket").agg(F.min(F.struct("rep", "n")).alias("least"), F.count("*").alias("c")).where("c > 1").select("bucket", F.col("least.rep").alias("hub"), F.col("least.n").alias("hub_n"))
    members = materialize(tables.join(buckets, "bucket"), "members")
    release(tables)

    wanted = materialize(known.join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"), "wanted")
    sets = materialize(set_arrays(docs.select("doc_id", "text").join(_small(wanted), "doc_id")).dropDuplicates(["doc_id"]), "sets")
    tried = members.where("rep != hub").where(f"100 * least(n, hub_n) >= {PERCENT} * greatest(n, hub_n)").select("hub", "rep").distinct()
    links = materialize(linked_to_hubs(materialize(tried, "pairs"), sets), "links")
    found = materialize(components(links), "components")

    placed = members.select("rep", "a").distinct().join(found.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = placed.groupBy("a").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("a")
    left = placed.join(mixed, "a", "left_semi").groupBy(F.col("rep").alias("doc_id"), "component").agg(F.collect_list("a").alias("keys"))
    rest = materialize(still_apart(materialize(left.join(sets, "doc_id").select(F.col("doc_id").alias("id"), "component", "keys", F.size("set").alias("n"), "set"), "left")), "apart")
    links = links.union(materialize(linked_in_buckets(rest), "links"))
    found = materialize(components(links), "components")
    release(members, sets)

    joined = known.join(classes, ["n", "s1", "s2"], "left").join(found.withColumnRenamed("id", "rep"), "rep", "left")
    joined = joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))
    nameless = sketches.where("doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return joined.union(nameless).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that near_duplicates() keeps: of rows that share a doc_id the least, all rows without one.

    Texts stay where they are unless more than MAX_BROADCAST_IDS documents go or more share their doc_id with another row.
    """
    found = materialize(near_duplicates(docs).where("doc_id is not null").select("doc_id", "kept"), "decisions")
    gone = found.where("not kept").select("doc_id")
    shared = materialize(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id"), "shared-ids")
    left = docs.join(_small(gone), "doc_id", "left_anti")
    if shared.isEmpty():
        return left.select(*docs.columns)
    others = [c for c in docs.columns if c != "doc_id"]
    one = left.join(_small(shared), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*others)).alias("row")).select("doc_id", "row.*")
    return left.join(_small(shared), "doc_id", "left_anti").select(*docs.columns).unionByName(one)


def _small(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS else ids


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
