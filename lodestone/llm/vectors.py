"""What the vector operators share: clean vectors, bounded samples, k-means, and blockwise meetings of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_batches, parallelism


def usable(vector: str) -> Column:
    """Whether a vector takes part: not null or empty, not zero, without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def clean(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vector): the usable vectors of the most common size, one for each id (of several the least).

    Single-precision vectors stay so while they travel; all arithmetic is in double precision.
    """
    kind = "array<float>" if df.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    rows = df.where(F.col(key).isNotNull() & usable(vector)).select(F.col(key).cast("long").alias("id"), F.col(vector).cast(kind).alias("vector"))
    rows = rows.groupBy("id").agg(F.min("vector").alias("vector"))
    sizes = rows.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    return rows.where(F.size("vector") == (sizes.n if sizes else 0))


def matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    return flat.reshape(n, len(flat) // n if n else 0)


def sample(rows: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of at most so many rows, taken by a hash of the id."""
    found = rows.select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(most).toArrow()
    return found.column("id").to_numpy(), matrix(found.column("vector"))


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x @ centres.T - 0.5 * (centres * centres).sum(1)).argmax(1)


def k_means(x: np.ndarray, k: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        of = nearest(x, centres)
        count = np.bincount(of, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        full = count > 0
        centres[full] = sums[full] / count[full, None]
    return centres


#: Members of a cell above which it is split once more, on a sample of its own of at most SPLIT_SAMPLE.
SPLIT_ABOVE, SPLIT_SAMPLE = 65_536, 4_096
#: Sub-cells of a cell at most; a cell's key is its number times this, and the sub-cell's number.
SUB_CELLS = 1 << 16


def split_models(members: DataFrame, cell: str, fit: Callable[[np.ndarray, np.ndarray, int], bytes], above: int = SPLIT_ABOVE) -> dict[int, bytes]:
    """{cell: model} of the cells that hold more than above members; fit(ids, vectors, members) makes each, in a task of its
    own, from the cell's sample.  Cells are as many at most as the first level has, and a model is as large as its sample
    allows, so what the driver gets is bounded."""
    sizes = members.groupBy(cell).agg(F.count("*").alias("c")).where(F.col("c") > above)
    if not (large := {r[0]: r.c for r in sizes.collect()}):
        return {}
    chosen = members.join(F.broadcast(sizes.select(cell)), cell, "left_semi").select(cell, "id", "vector")
    first = Window.partitionBy(cell).orderBy(F.xxhash64("id", F.lit(2)), "id")
    sampled = chosen.withColumn("__k", F.row_number().over(first)).where(F.col("__k") <= SPLIT_SAMPLE).drop("__k")

    def run(table: pa.Table) -> pa.Table:
        number = table.column(0)[0].as_py()
        model = fit(table.column("id").to_numpy(), matrix(table.column("vector")), large[number])
        return pa.table({"cell": pa.array([number], pa.int32()), "model": pa.array([model], pa.binary())})

    return {r.cell: bytes(r.model) for r in sampled.groupBy(cell).applyInArrow(run, "cell int, model binary").collect()}


def meet(members: DataFrame, queries: DataFrame, cell: str, block_rows: int, split_rows: int, run: Callable, schema: str) -> DataFrame:
    """Brings the members and queries of each cell together in bounded blocks.

    Both have cell, id and further columns in common.  A cell's members are dealt to blocks of about block_rows, its
    queries to splits of about split_rows, and each block meets each split.  run(members, queries) is given a block's
    members as one table and a split's queries batch by batch, so a task holds one block and one batch.
    """
    kept = [c for c in members.columns if c != cell]
    spark = members.sparkSession
    held = members.groupBy(cell).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("__blocks"))
    asked = queries.groupBy(cell).agg(F.ceil(F.count("*") / split_rows).cast("int").alias("__splits"))
    sizes = F.broadcast(held.join(asked, cell))
    left = members.join(sizes, cell).withColumn("__block", F.pmod(F.xxhash64("id"), F.col("__blocks")).cast("int")).withColumn("__split", F.explode(F.sequence(F.lit(0), F.col("__splits") - 1)))
    right = queries.join(sizes, cell).withColumn("__split", F.pmod(F.xxhash64("id", F.lit(1)), F.col("__splits")).cast("int")).withColumn("__block", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    columns = [cell, "__block", "__split", "__kind", *kept]
    rows = left.withColumn("__kind", F.lit(0)).select(columns).union(right.withColumn("__kind", F.lit(1)).select(columns))
    keys = [cell, "__block", "__split"]
    rows = rows.repartition(parallelism(spark), *keys).sortWithinPartitions(*keys, "__kind")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, held = None, [], None
        for batch in batches:
            marks = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]) if batch.num_rows else np.zeros((0, 4))
            cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
            for first, last in zip(cuts, cuts[1:], strict=False):
                place, kind = tuple(marks[first, :3]), marks[first, 3]
                if place != at:
                    at, parts, held = place, [], None
                part = batch.slice(first, last - first)
                if kind == 0:
                    parts.append(part)
                elif parts:
                    held = held if held is not None else pa.Table.from_batches(parts).combine_chunks()
                    yield from run(held, part)

    return in_batches(rows, each, schema)
