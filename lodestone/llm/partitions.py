"""Approximate nearest neighbours by learned partitions.

On a bounded sample, the graph of nearest neighbours is cut into parts of about equal size so that few edges are cut, and
a small network learns to tell the parts that a vector's neighbours are in.  It assigns every row to its most probable part
and sends a query to its several most probable ones, as many as the sample needs for the recall asked for; there all rows
are ranked exactly.  Parts that were neighbours when the sample was split travel as one group, so a query travels once to a
group.  The sample itself bounds each query's score from below, so only rows that can be among its best come back.  A part
that holds too many rows is cut again in the same way, on a sample of its own; a query that visits it visits the most
probable of its parts.
"""

from __future__ import annotations

import copy
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_batches, materialize, read, release
from .vectors import SPLIT_ABOVE, SUB_CELLS, clean, matrix, meet, sample, split_models

TOP = 20
#: Vectors the graph, the parts and the network are fitted on at most.
SAMPLE_ROWS = 16_384
GRAPH_DEGREE = 10
#: There are PARTS * sqrt(rows) parts, but at least PART_ROWS rows of the sample in each.
PARTS, PART_ROWS = 2, 32
SLACK = 1.1
HIDDEN = 96
#: Weight of a row's own part among the parts of its neighbours, which have 1 together.
OWN = 0.2
#: Recall that the number of parts a query visits is set for, on HELD sample queries the network hasn't seen.
RECALL, HELD = 0.94, 512
BLOCK_ROWS, SPLIT_ROWS = 2_048, 8_192


def neighbour_graph(x: np.ndarray, degree: int) -> np.ndarray:
    """rows x degree: the largest inner products."""
    out = np.zeros((len(x), degree), np.int64)
    for first in range(0, len(x), 512):
        scores = x[first : first + 512] @ x.T
        scores[np.arange(len(scores)), np.arange(first, first + len(scores))] = -np.inf
        out[first : first + 512] = np.argpartition(-scores, degree - 1, axis=1)[:, :degree]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, seed: int = 3, sweeps: int = 12) -> np.ndarray:
    """A part of each row: median splits to begin with, then moves that uncut the most edges while parts have room."""
    rng = np.random.default_rng(seed)
    label = np.zeros(len(x), np.int64)
    groups = [(np.arange(len(x)), 0, parts)]
    while groups:
        rows, first, n = groups.pop()
        if n == 1:
            label[rows] = first
            continue
        order = rows[np.argsort((x[rows] - x[rows].mean(0)) @ rng.standard_normal(x.shape[1]), kind="stable")]
        cut = len(rows) * (n // 2) // n
        groups += [(order[:cut], first, n // 2), (order[cut:], first + n // 2, n - n // 2)]
    room = int(np.ceil(SLACK * len(x) / parts))
    source = np.repeat(np.arange(len(x)), graph.shape[1])
    for _ in range(sweeps):
        votes = np.zeros((len(x), parts), np.int32)
        np.add.at(votes, (source, label[graph.ravel()]), 1)
        np.add.at(votes, (graph.ravel(), label[source]), 1)
        best = votes.argmax(1)
        gain = votes[np.arange(len(x)), best] - votes[np.arange(len(x)), label]
        size = np.bincount(label, minlength=parts)
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[best[i]] < room and rng.random() < 0.7:
                size[label[i]] -= 1
                size[best[i]] += 1
                label[i] = best[i]
                moved += 1
        if not moved:
            break
    return label


class Router:
    """One hidden layer and a softmax over parts."""

    def __init__(self, x: np.ndarray, target: np.ndarray, epochs: int = 20, seed: int = 9):
        rng = np.random.default_rng(seed)
        self.scale = 1 / max(1e-12, float(np.sqrt((x * x).sum(1).mean())))
        n, parts = x.shape[1], target.shape[1]
        self.w = [rng.standard_normal((n, HIDDEN)) * np.sqrt(2 / n), np.zeros(HIDDEN), rng.standard_normal((HIDDEN, parts)) * np.sqrt(1 / HIDDEN), np.zeros(parts)]
        mean, square, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for first in range(0, len(x), 256):
                rows = order[first : first + 256]
                inner = x[rows] * self.scale
                hidden = np.maximum(inner @ self.w[0] + self.w[1], 0)
                error = (_softmax(hidden @ self.w[2] + self.w[3]) - target[rows]) / len(rows)
                back = (error @ self.w[2].T) * (hidden > 0)
                t += 1
                for k, g in enumerate((inner.T @ back, back.sum(0), hidden.T @ error, error.sum(0))):
                    mean[k] += 0.1 * (g - mean[k])
                    square[k] += 0.001 * (g * g - square[k])
                    self.w[k] -= 0.003 * (mean[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.999**t)) + 1e-8)

    def chances(self, x: np.ndarray) -> np.ndarray:
        return _softmax(np.maximum(x * self.scale @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3])


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


class Parts:
    """A router, how many parts a query visits, the group that each part travels in, and the sample."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, total: int, top: int, recall: float):
        self.ids, self.x, self.top = ids, x, top
        self.parts = int(np.clip(round(PARTS * total**0.5), 1, max(1, len(x) // PART_ROWS)))
        self.groups = max(1, round(self.parts**0.5))
        self.group = (np.arange(self.parts) * self.groups // self.parts).astype(np.int32)
        held = min(HELD, len(x) // 8) if self.parts > 1 else 0
        seen = x[held:]
        degree = min(GRAPH_DEGREE, len(seen) - 1)
        label, near = np.zeros(len(seen), np.int64), np.zeros((len(seen), 0), np.int64)
        if self.parts > 1:
            near = neighbour_graph(seen, degree)
            label = balanced_parts(seen, near, self.parts)
        target = np.zeros((len(seen), self.parts))
        target[np.arange(len(seen)), label] = OWN
        np.add.at(target, (np.repeat(np.arange(len(seen)), near.shape[1]), label[near.ravel()]), 1.0 / GRAPH_DEGREE)
        self.router = Router(seen, target / target.sum(1, keepdims=True))
        self.visits, self.homes = 1, self.route(x, 1)[:, 0]
        if held:
            # the sample's neighbours that lie as near as the top ones among all rows
            close = max(1, min(len(seen), round(top * len(seen) / total)))
            home = self.router.chances(seen).argmax(1)
            true = np.argsort(-(x[:held] @ seen.T), axis=1)[:, :close]
            rank = np.argsort(np.argsort(-self.router.chances(x[:held]), axis=1), axis=1)
            needed = np.sort(np.take_along_axis(rank, home[true], 1).ravel())
            self.visits = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1

    def light(self) -> bytes:
        """What routing takes, for a part that is cut again."""
        held = copy.copy(self)
        held.ids = held.x = held.homes = None
        held.router = copy.copy(self.router)
        held.router.w = [w.astype(np.float32) for w in self.router.w]
        return pickle.dumps(held)

    def visited(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """queries x parts: the most probable parts of each, visits of them or as many as it takes for enough rows."""
        order = self.route(x, self.parts)
        needed = (np.cumsum(sizes[order], axis=1) <= self.top).sum(1) + 1
        out = np.zeros((len(x), self.parts), bool)
        np.put_along_axis(out, order, np.arange(self.parts) < np.maximum(self.visits, needed)[:, None], axis=1)
        return out

    def route(self, x: np.ndarray, visits: int) -> np.ndarray:
        """The most probable parts of each vector, the most probable one first."""
        return np.argsort(-self.router.chances(x), axis=1, kind="stable")[:, :visits].astype(np.int32)

    def floors(self, names: np.ndarray, q: np.ndarray, visited: np.ndarray) -> np.ndarray:
        """A score that each query's top rows reach, as the sample alone has that many in the parts it visits whole."""
        out = np.full(len(q), -np.inf)
        for first in range(0, len(q), 256):
            scores = q[first : first + 256] @ self.x.T
            scores[(names[first : first + 256, None] == self.ids[None, :]) | ~visited[first : first + 256][:, self.homes]] = -np.inf
            if len(self.ids) > self.top:
                out[first : first + 256] = np.partition(scores, len(self.ids) - self.top, axis=1)[:, len(self.ids) - self.top]
        return out


def best_of_block(names: np.ndarray, q: np.ndarray, visits: np.ndarray, floors: np.ndarray, ids: np.ndarray, parts: np.ndarray, x: np.ndarray, top: int) -> tuple[np.ndarray, ...]:
    """(query, id, score) of each query's top rows in the parts it visits, of those that reach its floor.

    x is sorted by part; visits says for each query which distinct parts, in that order, it visits.
    """
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(parts)) + 1, [len(parts)]])
    out: tuple[list, list, list] = ([], [], [])
    size = np.abs(x).max() * x.shape[1]
    for first in range(0, len(q), 256):
        rows = slice(first, first + 256)
        scores = np.full((len(q[rows]), len(ids)), -np.inf)
        for k, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False)):
            asks = np.flatnonzero(visits[rows, k])
            scores[asks, low:high] = q[rows][asks] @ x[low:high].T
        scores[names[rows, None] == ids[None, :]] = -np.inf
        n = min(top, len(ids))
        floor = np.maximum(np.partition(scores, len(ids) - n, axis=1)[:, len(ids) - n], floors[rows])
        # all that rounding could place among the best are scored again in one order of summation
        slack = 1e-13 * size * (np.abs(q[rows]).max(1) + 1e-300)
        a, b = np.nonzero((scores >= (floor - slack)[:, None]) & (scores > -np.inf))
        exact = (x[b] * q[rows][a]).sum(1)
        order = np.lexsort((ids[b], -exact, a))
        a, b, exact = a[order], b[order], exact[order]
        place = np.arange(len(a)) - np.searchsorted(a, a)
        keep = place < n
        for column, values in zip(out, (names[rows][a], ids[b], exact), strict=True):
            column.append(values[keep])
    return tuple(np.concatenate(c) for c in out)


def search(rows: DataFrame, queries: DataFrame, top: int = TOP, recall: float = RECALL, key: str = "vec_id", vector: str = "embedding", split_above: int = SPLIT_ABOVE) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's top rows found, by inner product in double precision.

    Ties go to the smaller id; a row with the query's own id is no candidate.  Rows and queries with null ids, and vectors
    that are null, empty, zero, of an odd size or hold null or non-finite components take no part.  Of rows that share
    an id with different vectors the least counts.
    """
    spark = rows.sparkSession
    every = materialize(clean(rows, key, vector), "search-vectors")
    total = every.count()
    asked = clean(queries, key, vector)
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    names, points = sample(every, SAMPLE_ROWS)
    shared = spark.sparkContext.broadcast(Parts(names, points, total, top, recall))
    dims, kind = points.shape[1], every.schema["vector"].dataType.simpleString()

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = shared.value.route(matrix(batch.column("vector")), 1)[:, 0]
            yield pa.RecordBatch.from_arrays([pa.array(best), batch.column("id"), batch.column("vector")], ["part", "id", "vector"])

    def of_size(df: DataFrame) -> DataFrame:
        return df.where(F.size("vector") == dims).select("id", "vector")

    homed = materialize(in_batches(of_size(every), homes, f"part int, id long, vector {kind}"), "homed-vectors")
    models = split_models(homed, "part", lambda ids, x, total: Parts(ids, x, total, top, recall).light(), split_above)
    cut = spark.sparkContext.broadcast(models)

    held: dict[int, Parts] = {}

    def inner(part: int) -> Parts:
        """The parts of a part that is cut again."""
        if part not in held:
            held[part] = pickle.loads(cut.value[part])
        return held[part]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with their cell, a group of parts or a part of a part, and their part in it."""
        for batch in batches:
            home = batch.column("part").to_numpy(zero_copy_only=False).astype(np.int64)
            cell, part = shared.value.group[home].astype(np.int64), home.copy()
            for p in np.unique(home[np.isin(home, list(cut.value))]).tolist():
                at = np.flatnonzero(home == p)
                cell[at] = part[at] = (p + 1) * SUB_CELLS + inner(p).route(matrix(batch.column("vector").take(pa.array(at))), 1)[:, 0]
            yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column("id"), pa.array(part), batch.column("vector")], ["cell", "id", "part", "vector"])

    members = materialize(in_batches(homed, placed, f"cell long, id long, part long, vector {kind}"), "placed-vectors")
    release(homed)
    # a row for each part, and for each part of a part that is cut again
    counted = spark.sparkContext.broadcast({r.part: r.n for r in members.groupBy("part").agg(F.count("*").alias("n")).collect()})

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each cell that a query visits, with the parts it visits there."""
        parts, count = shared.value, counted.value
        within = {p: np.array([count.get((p + 1) * SUB_CELLS + k, 0) for k in range(inner(p).parts)]) for p in cut.value}
        sizes = np.array([within[p].sum() if p in within else count.get(p, 0) for p in range(parts.parts)])
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                rows = batch.slice(first, 1024)
                q = matrix(rows.column("vector"))
                visited = parts.visited(q, sizes)
                whole = visited.copy()
                whole[:, list(within)] = False
                floors = parts.floors(rows.column("id").to_numpy(zero_copy_only=False), q, whole)
                owner, part = np.nonzero(whole)
                found = [(owner, parts.group[part].astype(np.int64), part)]
                for p in within:
                    if len(asks := np.flatnonzero(visited[:, p])):
                        owner, sub = np.nonzero(inner(p).visited(q[asks], within[p]))
                        found.append((asks[owner], (p + 1) * SUB_CELLS + sub, (p + 1) * SUB_CELLS + sub))
                owner, cell, part = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.lexsort((part, cell, owner))
                owner, cell, part = owner[order], cell[order], part[order]
                opens = np.ones(len(owner), bool)
                opens[1:] = (owner[1:] != owner[:-1]) | (cell[1:] != cell[:-1])
                begins = np.append(np.flatnonzero(opens), len(owner)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(begins), pa.array(part))
                of = pa.array(owner[opens])
                yield pa.RecordBatch.from_arrays([pa.array(cell[opens]), rows.column("id").take(of), rows.column("vector").take(of), lists, pa.array(floors[owner[opens]])], ["cell", "id", "vector", "parts", "floor"])

    nothing = {c: F.lit(None).cast(t).alias(c) for c, t in (("part", "long"), ("parts", "array<long>"), ("floor", "double"))}
    members = members.select("cell", "id", "part", "vector", nothing["parts"], nothing["floor"])
    visitors = in_batches(of_size(asked), sent, f"cell long, id long, vector {kind}, parts array<long>, floor double").select("cell", "id", nothing["part"], "vector", "parts", "floor")

    def rank(held: pa.Table, asked: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        part = held.column("part").to_numpy()
        order, known = np.argsort(part, kind="stable"), np.unique(part)
        lists = asked.column("parts")
        wanted = lists.flatten().to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
        hit = known[at] == wanted
        visits = np.zeros((asked.num_rows, len(known)), bool)
        visits[np.repeat(np.arange(asked.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))[hit], at[hit]] = True
        floors = asked.column("floor").to_numpy(zero_copy_only=False)
        found = best_of_block(asked.column("id").to_numpy(zero_copy_only=False), matrix(asked.column("vector")), visits, floors, held.column("id").to_numpy()[order], part[order], matrix(held.column("vector"))[order], top)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["query_id", "vec_id", "score"])

    found = meet(members, visitors, "cell", BLOCK_ROWS, SPLIT_ROWS, rank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op6_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return search(rows, rows.where("vec_id % 20 = 0"))
