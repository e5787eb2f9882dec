"""Near-duplicate vectors by product quantisation.

Unit vectors go to the nearest of a set of coarse centres; what is left of them is coded by subspace.  Of two linked vectors
in different lists the line between them crosses the border of the lists, so one of them lies within half of its share
along the border's normal.  A vector probes every list whose border is that near, where the share is REACH standard
deviations of it as the sample's spread about its centres has them along that very normal, never more than the linking
distance itself; and more, if pairs of the sample itself need more.  So flat or low-ranked data widen the probes by
themselves.  In a list distances to the coded vectors are sums of table entries.  The coding error of each vector is known
exactly, so a candidate is dropped only if it can't be near enough, and the rest are confirmed by their exact cosine.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches, materialize, read
from .graph import components, forest
from .vectors import SPLIT_ABOVE, SUB_CELLS, clean, k_means, matrix, meet, nearest, sample, split_models

LINK = 0.9
#: Vectors the centres and codes are fitted on at most.
SAMPLE_ROWS = 16_384
SUBSPACES, CODES = 8, 128
#: Standard deviations of a linked pair's share along a border's normal that probes allow for; None allows for all of it.
REACH = 4.0
#: Rows of the sample whose linked pairs in the sample must all be found.
CHECKED_ROWS = 2_048
BLOCK_ROWS, SPLIT_ROWS = 2_048, 32_768


class Lists:
    """Centres for unit vectors, and how near to the border between two lists a vector must be to probe the other one."""

    def __init__(self, centres: np.ndarray, spread: np.ndarray, share: float, reach: float | None):
        self.centres, self.spread, self.share, self.reach = centres, spread, share, reach
        self.apart = np.sqrt(_squares(centres, np.eye(centres.shape[1])))
        self.limit = np.full((len(centres), len(centres)), share)
        if reach is not None:
            self.limit = np.minimum(share, reach * self.each())

    def each(self) -> np.ndarray:
        """One standard deviation of a linked pair's share along the normal of each border."""
        return self.share * np.sqrt(_squares(self.centres, self.spread)) / np.maximum(self.apart, 1e-12)

    @classmethod
    def fitted(cls, x: np.ndarray, lists: int, share: float, reach: float | None, link: float) -> Lists:
        centres = k_means(x, lists)
        home = nearest(x, centres)
        rest = x - centres[home]
        spread = rest.T @ rest
        found = cls(centres, spread / max(np.trace(spread), 1e-300), share, reach)
        return found if reach is None else cls(centres, found.spread, share, max(reach, 1.25 * found._needed(x, home, link)))

    def _needed(self, x: np.ndarray, home: np.ndarray, link: float) -> float:
        """The least reach that finds all linked pairs of the sample's first CHECKED_ROWS rows with the rest of it."""
        most, each = 0.0, self.each()
        for first in range(0, min(CHECKED_ROWS, len(x)), 256):
            i, j = np.nonzero(x[first : first + 256] @ x.T >= link)
            i += first
            i, j = i[home[i] != home[j]], j[home[i] != home[j]]
            if len(i):
                gap = [self._gaps(x[a], home[a], home[b]) for a, b in ((i, j), (j, i))]
                most = max(most, float((np.minimum(*gap) / np.maximum(each[home[i], home[j]], 1e-12)).max()))
        return most

    def _gaps(self, x: np.ndarray, home: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Distances of vectors to the borders of their lists with others."""
        own, away = (((x - self.centres[c]) ** 2).sum(1) for c in (home, other))
        return (away - own) / np.maximum(2 * self.apart[home, other], 1e-12)

    def probes(self, x: np.ndarray, home: np.ndarray) -> np.ndarray:
        """vectors x lists: whether the border with a list is near enough."""
        away = -2 * (x @ self.centres.T) + (self.centres**2).sum(1)
        own = away[np.arange(len(x)), home]
        return away - own[:, None] <= 2 * self.limit[home] * self.apart[home] + 1e-9


def _many(total: int, sample: int) -> int:
    return int(np.clip(2 ** round(math.log2(max(1.0, math.sqrt(total)))), 1, max(1, sample // 16)))


class Index(Lists):
    """Lists and codes for unit vectors."""

    def __init__(self, x: np.ndarray, total: int, far: float, reach: float | None = REACH):
        found = Lists.fitted(x, _many(total, len(x)), far / 2, reach, 1 - far * far / 2)
        super().__init__(found.centres, found.spread, found.share, found.reach)
        rest = x - self.centres[nearest(x, self.centres)]
        self.cuts = np.linspace(0, x.shape[1], min(SUBSPACES, x.shape[1]) + 1).astype(int)
        self.books = [k_means(rest[:, a:b], min(CODES, len(rest)), rounds=6) for a, b in zip(self.cuts, self.cuts[1:], strict=False)]

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, coding error)"""
        home = nearest(x, self.centres)
        rest = x - self.centres[home]
        codes = np.column_stack([nearest(rest[:, a:b], book) for a, b, book in zip(self.cuts, self.cuts[1:], self.books, strict=False)]).astype(np.uint8)
        return home, codes, np.sqrt(((rest - self.decode(codes)) ** 2).sum(1))

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([book[codes[:, k]] for k, book in enumerate(self.books)], axis=1)

    def distances(self, x: np.ndarray, centre: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Squared distances of x to coded vectors of one list, from tables for each subspace."""
        rest = x - centre
        out = np.zeros((len(x), len(codes)), np.float32)
        for k, (a, b, book) in enumerate(zip(self.cuts, self.cuts[1:], self.books, strict=False)):
            part = rest[:, a:b]
            table = ((part * part).sum(1)[:, None] - 2 * part @ book.T + (book * book).sum(1)).astype(np.float32)
            out += table[:, codes[:, k]]
        return out


def _squares(centres: np.ndarray, form: np.ndarray) -> np.ndarray:
    """(a - b)' form (a - b) for all pairs of centres."""
    inner = centres @ form @ centres.T
    return np.maximum(np.diag(inner)[:, None] + np.diag(inner) - 2 * inner, 0)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _part_model(x: np.ndarray, total: int, far: float, reach: float | None) -> tuple:
    """What Lists() takes for the parts of one list of so many vectors, in single precision where that loses nothing."""
    found = Lists.fitted(x, _many(total, len(x)), far, reach, 1 - far * far / 2)
    return found.centres.astype(np.float32), found.spread.astype(np.float32), far, found.reach


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", link: float = LINK, reach: float | None = REACH, split_above: int = SPLIT_ABOVE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each id of df.

    Equal vectors are one class, so a vector repeated any number of times is compared once.  Vectors that are null,
    empty, zero, hold null or non-finite components or have an odd size link with nothing.  Of rows that share an id with
    different vectors the least usable vector counts.  Rows with a null id come back with a null component_id, and kept.
    With reach=None no link can be lost; else see REACH.
    """
    spark = df.sparkSession
    rows = clean(df, key, vector).withColumns({"k1": F.xxhash64("vector"), "k2": F.xxhash64(F.lit(1), "vector")})
    rows = materialize(rows, "vectors")
    classes = rows.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.count("*").alias("weight"))
    classes = materialize(classes, "vector-classes")
    heads = rows.select("id", "vector").join(classes.select("id", "weight"), "id")
    total = classes.count()
    _, points = sample(heads, SAMPLE_ROWS)
    ids = df.select(F.col(key).cast("long").alias("vec_id")).where("vec_id is not null").distinct()
    nameless = df.where(F.col(key).isNull()).select(F.lit(None).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    if not total:
        alone = ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        return alone.union(nameless).withColumn("kept", F.lit(True))
    far = math.sqrt(max(0.0, 2 - 2 * link))
    shared = spark.sparkContext.broadcast(Index(unit(points), total, far, reach))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for first in range(0, batch.num_rows, 2048):
                part = batch.slice(first, 2048)
                x = unit(matrix(part.column("vector")))
                home, codes, error = index.place(x)
                near = index.probes(x, home)
                flat = pa.array(np.nonzero(near)[1].astype(np.int32))
                probes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(near.sum(1))]), pa.int32()), flat)
                coded = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("weight"), part.column("vector"), pa.array(home.astype(np.int32)), coded, pa.array(error), probes], ["id", "weight", "vector", "home", "codes", "error", "probes"])

    placed = in_batches(heads.select("id", "weight", "vector"), place, f"id long, weight long, vector {heads.schema['vector'].dataType.simpleString()}, home int, codes binary, error double, probes array<int>")
    placed = materialize(placed, "coded-vectors")
    columns = ("id", "weight", "vector", "codes", "error", "home", "probes")
    lone = {"codes": F.lit(None).cast("binary"), "error": F.lit(0.0), "probes": F.lit(None).cast("array<int>")}
    members = placed.select(F.col("home").alias("cell"), *columns)
    queries = placed.select(F.explode("probes").alias("cell"), *(lone.get(c, F.col(c)).alias(c) for c in columns))
    models = split_models(members, "cell", lambda ids, x, total: pickle.dumps(_part_model(unit(x), total, far, reach)), split_above)
    parts = spark.sparkContext.broadcast(models)

    def dealt(asking: bool) -> Callable:
        """Rows by the key of their cell's part: its own for members, all those it probes for queries."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, Lists] = {}
            for batch in batches:
                cells = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                keys, rows = [], []
                for cell in np.unique(cells).tolist():
                    at = np.flatnonzero(cells == cell)
                    if cell not in parts.value:
                        keys.append(np.full(len(at), cell * SUB_CELLS))
                        rows.append(at)
                        continue
                    if cell not in held:
                        held[cell] = Lists(*(x.astype(np.float64) if isinstance(x, np.ndarray) else x for x in pickle.loads(parts.value[cell])))
                    x = unit(matrix(batch.column("vector").take(pa.array(at))))
                    home = nearest(x, held[cell].centres)
                    which, sub = np.nonzero(held[cell].probes(x, home)) if asking else (np.arange(len(at)), home)
                    keys.append(cell * SUB_CELLS + sub)
                    rows.append(at[which])
                keys, rows = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, rows))
                for first in range(0, len(rows), 4_096):
                    part = pa.array(rows[first : first + 4_096])
                    yield pa.RecordBatch.from_arrays([pa.array(keys[first : first + 4_096]), *(c.take(part) for c in batch.columns[1:])], batch.schema.names)

        return run

    keyed = T.StructType([T.StructField("cell", T.LongType()), *members.schema.fields[1:]])
    if models:
        members, queries = in_batches(members, dealt(False), keyed), in_batches(queries, dealt(True), keyed)
    else:
        members, queries = (df.withColumn("cell", F.col("cell").cast("long") * SUB_CELLS) for df in (members, queries))

    def link_up(held: pa.Table, asked: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Rows (u, v, n): n links of u if v is null, else an edge of a spanning forest of the links found here."""
        index = shared.value
        cell = asked.column("cell")[0].as_py() // SUB_CELLS
        ids, weight = held.column("id").to_numpy(), held.column("weight").to_numpy()
        exact = unit(matrix(held.column("vector")))
        codes = np.frombuffer(b"".join(held.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)
        limit = (far + held.column("error").to_numpy() + 1e-4) ** 2
        names, mass = asked.column("id").to_numpy(zero_copy_only=False), asked.column("weight").to_numpy(zero_copy_only=False)
        x = unit(matrix(asked.column("vector")))
        home = asked.column("home").to_numpy(zero_copy_only=False)
        probes = held.column("probes").combine_chunks()
        asks = np.zeros((len(index.centres), len(ids)), bool)
        asks[probes.flatten().to_numpy(), np.repeat(np.arange(len(ids)), probes.value_lengths().to_numpy())] = True
        found = []
        for first in range(0, len(x), 512):
            rough = index.distances(x[first : first + 512], index.centres[cell], codes) <= limit
            # a pair whose vectors probe each other's lists counts where the smaller id asks
            rough &= (ids[None, :] > names[first : first + 512, None]) | ~asks[home[first : first + 512]]
            a, b = np.nonzero(rough)
            for low in range(0, len(a), 65_536):
                i, j = a[low : low + 65_536] + first, b[low : low + 65_536]
                ok = (x[i] * exact[j]).sum(1) >= link
                found.append((i[ok], j[ok]))
        i, j = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in (0, 1))
        if not len(i):
            return
        left = np.bincount(i, weight[j], len(x)).astype(np.int64)
        right = np.bincount(j, mass[i], len(ids)).astype(np.int64)
        a, b = np.flatnonzero(left), np.flatnonzero(right)
        u, v = forest(names[i], ids[j])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([names[a], ids[b], u])), pa.array([None] * (len(a) + len(b)) + v.tolist(), pa.int64()), pa.array(np.concatenate([left[a], right[b], np.zeros(len(u), np.int64)]))],
            ["u", "v", "n"],
        )

    links = materialize(meet(members, queries, "cell", BLOCK_ROWS, SPLIT_ROWS, link_up, "u long, v long, n long"), "vector-links")
    counts = links.where("v is null").groupBy(F.col("u").alias("id")).agg(F.sum("n").alias("others"))
    found = components(links.where("v is not null").select("u", "v"))
    each = classes.join(counts, "id", "left").join(found, "id", "left")
    each = each.select("k1", "k2", (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n"), F.coalesce("component", "id").alias("component"))
    known = rows.select("id", "k1", "k2").join(each, ["k1", "k2"]).select(F.col("id").alias("vec_id"), "n", "component")
    out = ids.join(known, "vec_id", "left").select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.union(nameless).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op10_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))
