"""Reciprocal rank fusion."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rrf(*lists: list, k: int = 60) -> list[dict]:
    """Items by the sum of 1 / (k + rank) over the lists; the last place of a repeated item counts, ties keep their order."""
    found: dict = {}
    for items in lists:
        places = {item: n for n, item in enumerate(items, 1)}
        for item, n in places.items():
            found[item] = found.get(item, 0.0) + 1.0 / (k + n)
    return [{"result": item, "score": score} for item, score in sorted(found.items(), key=lambda p: -p[1])]


def rrf_frames(*lists: DataFrame, key: str, k: int = 60) -> DataFrame:
    """The same over ranked DataFrames (key, rank): key, score, best first."""
    parts = [df.groupBy(key).agg(F.max("rank").alias("rank")).withColumn("list", F.lit(n)) for n, df in enumerate(lists)]
    every = functools.reduce(DataFrame.unionByName, parts)
    fused = every.groupBy(key).agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("first"))
    return fused.orderBy(F.desc("score"), "first").select(key, "score")


def ranked(df: DataFrame, key: str, score: str) -> DataFrame:
    """(key, rank) of a bounded result by its score."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key))).select(key, "rank")
