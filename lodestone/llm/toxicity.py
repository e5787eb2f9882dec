"""Toxicity: a small convolutional text classifier over hashed word embeddings.

Words are runs of letters and numbers, lower-cased; a word's embedding is the sum of those that it and its beginnings hash
to.  Filters of several widths run over a text's
words, each filter's maximum over the whole text is kept, and a logistic layer gives the score.  The model is trained in
numpy on the driver, on a bounded sample; scoring runs over whole texts in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches, read
from .textkit import NUMBER, classes, code_points, mix, point_values, prefixes, ranges, runs, segment, slices, text_chunks

WIDTHS = (1, 2, 3)
FILTERS = 12
SIZE = 12
BUCKETS = 1 << 17
#: Lengths of the beginnings that share in a longer word's embedding.
BEGINNINGS = (4, 5, 6, 7)
#: Labelled rows the model is trained on at most, taken by a hash of the id, and the characters that they have together:
#: the row that reaches the bound is the last one, whatever its length.
MAX_TRAIN_ROWS = 6_000
MAX_TRAIN_CHARS = 20_000_000
EPOCHS = 8
#: Rows of the sample that set the thresholds instead of the weights: one in so many.
CALIBRATION = 5


@dataclass
class Model:
    embed: np.ndarray  # BUCKETS + 1 x SIZE, the last one zero
    filters: dict[int, np.ndarray]  # width -> width x SIZE x FILTERS
    bias: np.ndarray
    weight: np.ndarray
    offset: float
    thresholds: dict[str, float]


@dataclass
class Words:
    """Texts as codes of their words, one after another; parts has the buckets of each code, BUCKETS for none."""

    codes: np.ndarray
    bounds: np.ndarray
    parts: np.ndarray


def read_words(texts: list[str]) -> Words:
    points, bounds = code_points([t.lower() for t in texts])
    if not len(points):
        return Words(np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64), np.zeros((0, 1 + len(BEGINNINGS)), np.int32))
    start, end = runs(classes()[points] <= NUMBER, bounds)
    prefix = prefixes(point_values(points))
    codes, _ = pd.factorize(ranges(prefix, start, end))
    seen = np.maximum.accumulate(codes) if len(codes) else codes
    first = np.flatnonzero(np.concatenate([[True], seen[1:] > seen[:-1]])) if len(codes) else np.zeros(0, np.int64)
    start_, end_ = start[first], end[first]
    parts = np.full((len(first), 1 + len(BEGINNINGS)), BUCKETS, np.int32)
    parts[:, 0] = ranges(prefix, start_, end_) >> np.uint64(47)
    for k, n in enumerate(BEGINNINGS, 1):
        longer = end_ - start_ > n
        parts[longer, k] = ranges(prefix, start_[longer], start_[longer] + n) >> np.uint64(47)
    return Words(codes.astype(np.int64), np.searchsorted(start, bounds), parts)


def fresh(seed: int = 11) -> Model:
    rng = np.random.default_rng(seed)
    embed = (rng.standard_normal((BUCKETS + 1, SIZE)) * 0.1).astype(np.float32)
    embed[BUCKETS] = 0
    filters = {w: (rng.standard_normal((w, SIZE, FILTERS)) * 0.3).astype(np.float32) for w in WIDTHS}
    n = len(WIDTHS) * FILTERS
    return Model(embed, filters, np.zeros(n, np.float32), (rng.standard_normal(n) * 0.1).astype(np.float32), 0.0, {})


def vectors(model: Model, words: Words) -> np.ndarray:
    out = np.zeros((len(words.parts), SIZE), model.embed.dtype)
    for k in range(words.parts.shape[1]):
        out += model.embed[words.parts[:, k]]
    return out[words.codes]


def pooled(model: Model, text: Words) -> np.ndarray:
    """texts x filters: each filter's maximum over a text, at least 0.  Short texts read as followed by zero vectors."""
    words, bounds = text.codes, text.bounds
    out = np.zeros((len(bounds) - 1, len(WIDTHS) * FILTERS), np.float32)
    if not len(words):
        return out
    rows = vectors(model, text)
    edge = np.zeros(len(words) + max(WIDTHS), bool)
    edge[bounds] = True
    for k, width in enumerate(WIDTHS):
        sums = rows @ model.filters[width][0]
        cut = np.zeros(len(words), bool)
        for j in range(1, width):
            cut |= edge[j : j + len(words)]
            part = rows[j:] @ model.filters[width][j]
            part[cut[: len(part)]] = 0
            sums[: len(part)] += part
        sums += model.bias[k * FILTERS : (k + 1) * FILTERS]
        out[:, k * FILTERS : (k + 1) * FILTERS] = segment(np.maximum, sums, bounds, 0)
    return np.maximum(out, 0)


def scores(model: Model, text: Words) -> np.ndarray:
    z = pooled(model, text).astype(np.float64) @ model.weight.astype(np.float64) + model.offset
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def gather(texts: list[np.ndarray], rows, parts: np.ndarray) -> Words:
    bounds = np.concatenate([[0], np.cumsum([len(texts[i]) for i in rows])]).astype(np.int64)
    found, codes = np.unique(np.concatenate([texts[i] for i in rows] or [np.zeros(0, np.int64)]), return_inverse=True)
    return Words(codes, bounds, parts[found])


@dataclass
class Gradients:
    """Of the loss() by each array of a model; embed has rows for the buckets that the texts' words have."""

    buckets: np.ndarray
    embed: np.ndarray
    filters: dict[int, np.ndarray]
    bias: np.ndarray
    weight: np.ndarray
    offset: float


def gradients(model: Model, text: Words, labels: np.ndarray, balance: np.ndarray) -> Gradients:
    """Gradients of the mean weighted cross-entropy and 5e-5 times the weights' square; maxima pass them to their places."""
    words, bounds, kind = text.codes, text.bounds, model.weight.dtype
    rows = vectors(model, text)
    best, place = _argmax(model, rows, bounds)
    z = best @ model.weight + model.offset
    error = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) * balance / len(labels)).astype(kind)
    back = np.outer(error, model.weight) * (best > 0)
    places, given, filters, bias = [], [], {}, np.zeros_like(model.bias)
    for k, width in enumerate(WIDTHS):
        part = back[:, k * FILTERS : (k + 1) * FILTERS]
        doc, f = np.nonzero(part)
        g, at = part[doc, f], place[doc, k * FILTERS + f]
        filters[width] = np.zeros_like(model.filters[width])
        for j in range(width):
            inside = at + j < bounds[doc + 1]
            w, fj, gj = words[at[inside] + j], f[inside], g[inside]
            np.add.at(filters[width][j].T, fj, gj[:, None] * rows[at[inside] + j])
            one = gj[:, None] * model.filters[width][j][:, fj].T
            for buckets in text.parts[w].T:
                places.append(buckets)
                given.append(one)
        np.add.at(bias, k * FILTERS + f, g)
    at, inverse = np.unique(np.concatenate(places), return_inverse=True)
    embed = np.zeros((len(at), SIZE), kind)
    np.add.at(embed, inverse, np.concatenate(given))
    embed[at == BUCKETS] = 0
    return Gradients(at, embed, filters, bias, best.T @ error + 1e-4 * model.weight, float(error.sum()))


def train(texts: list[np.ndarray], parts: np.ndarray, labels: np.ndarray, langs: list[str], epochs: int = EPOCHS, rate: float = 0.05, seed: int = 11) -> Model:
    """A model for texts given as codes of words, whose buckets are in parts.  Every CALIBRATION-th text only sets the thresholds."""
    model = fresh(seed)
    if not len(texts) or labels.min() == labels.max():
        model.offset = 0.0 if not len(texts) else float(np.where(labels.max() > 0, 3.0, -3.0))
        model.weight[:] = 0
        return model
    rng = np.random.default_rng(seed)
    held = np.arange(len(texts)) % CALIBRATION == CALIBRATION - 1
    rows, size = np.flatnonzero(~held), 64
    positive = max(1, int(labels[rows].sum()))
    balance = np.where(labels > 0, min(8.0, (len(rows) - positive) / positive), 1.0)
    eps, grown = 1e-6, {id(x): np.zeros_like(x) for x in (model.embed, model.bias, model.weight, *model.filters.values())}
    offset_grown = 0.0

    def step(array: np.ndarray, gradient: np.ndarray, at=slice(None)) -> None:
        seen = grown[id(array)]
        seen[at] += gradient * gradient
        array[at] -= rate * gradient / (np.sqrt(seen[at]) + eps)

    for _ in range(epochs):
        order = rng.permutation(rows)
        for first in range(0, len(order), size):
            batch = order[first : first + size]
            found = gradients(model, gather(texts, batch, parts), labels[batch], balance[batch])
            step(model.bias, found.bias)
            for width in WIDTHS:
                step(model.filters[width], found.filters[width])
            step(model.embed, found.embed, found.buckets)
            step(model.weight, found.weight)
            offset_grown += found.offset**2
            model.offset -= rate * found.offset / (offset_grown**0.5 + eps)
    held_rows = np.flatnonzero(held)
    model.thresholds = calibrate(scores(model, gather(texts, held_rows, parts)), labels[held_rows], [langs[i] for i in held_rows])
    return model


def _argmax(model: Model, rows: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maxima as pooled() has them, and where each stands."""
    n = len(bounds) - 1
    best, place = np.zeros((n, len(WIDTHS) * FILTERS), model.weight.dtype), np.zeros((n, len(WIDTHS) * FILTERS), np.int64)
    if not len(rows):
        return best, place
    end = np.repeat(bounds[1:], np.diff(bounds))
    for k, width in enumerate(WIDTHS):
        sums = rows @ model.filters[width][0]
        for j in range(1, width):
            part = rows[j:] @ model.filters[width][j]
            part[np.arange(len(part)) + j >= end[: len(part)]] = 0
            sums[: len(part)] += part
        sums += model.bias[k * FILTERS : (k + 1) * FILTERS]
        for d in range(n):
            if bounds[d + 1] > bounds[d]:
                at = sums[bounds[d] : bounds[d + 1]].argmax(0)
                place[d, k * FILTERS : (k + 1) * FILTERS] = at + bounds[d]
                best[d, k * FILTERS : (k + 1) * FILTERS] = np.maximum(sums[at + bounds[d], np.arange(FILTERS)], 0)
    return best, place


def calibrate(found: np.ndarray, labels: np.ndarray, langs: list[str]) -> dict[str, float]:
    """For each language the threshold of the best F1 on the calibration rows; '' is that of all languages."""

    def best(s: np.ndarray, y: np.ndarray) -> float:
        if not len(s) or y.sum() == 0:
            return 0.5
        order = np.argsort(-s, kind="stable")
        hit = np.cumsum(y[order])
        f1 = 2 * hit / (np.arange(1, len(s) + 1) + y.sum())
        k = int(np.argmax(f1))
        following = s[order[k + 1]] if k + 1 < len(s) else 0.0
        return float(np.clip((s[order[k]] + following) / 2, 0.05, 0.95))

    names = np.array([x or "" for x in langs], object)
    out = {"": best(found, labels)}
    for lang in sorted(set(names.tolist()) - {""}):
        rows = names == lang
        out[lang] = best(found[rows], labels[rows]) if labels[rows].sum() >= 20 else out[""]
    return out


def _word_lists(df: DataFrame) -> DataFrame:
    """(doc_id, toxic, lang, parts): the buckets of each text's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for first, last, texts in text_chunks(batch.column("text")):
                words = read_words(texts)
                parts = [words.parts[words.codes[i:j]].astype("<i4").tobytes() for i, j in zip(words.bounds[:-1], words.bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(c)[first:last] for c in ("doc_id", "toxic", "lang")] + [pa.array(parts, pa.binary())], ["doc_id", "toxic", "lang", "parts"])

    return in_batches(df.select("doc_id", F.col("toxic").cast("int"), F.col("lang").cast("string"), "text"), run, "doc_id long, toxic int, lang string, parts binary")


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS, max_chars: int = MAX_TRAIN_CHARS) -> Model:
    """A model from docs (doc_id, text, lang) and labels (doc_id, toxic).

    At most max_rows labelled texts are taken whole, by a hash of doc_id, half of them of label 1 if there are as many, and
    no more once they have max_chars characters.  Null labels don't count; of several labels of a document the largest
    does.  Equal rows train once, different texts of one doc_id each.  Without rows of both labels the score is a constant.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    half = [known.where(f"toxic {'>' if k else '<='} 0").orderBy(order, "doc_id").limit(max_rows // 2) for k in (0, 1)]
    chosen = half[0].unionAll(half[1])
    sizes = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.sum("n").alias("n"))
    before = Window.orderBy(order, "doc_id").rowsBetween(Window.unboundedPreceding, -1)  # max_rows rows at most
    chosen = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("before") < max_chars).select("doc_id", "toxic")
    found = _word_lists(docs.select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id"))
    rows = list({(r["doc_id"], r["lang"], r["parts"]): r for r in found.toArrow().to_pylist()}.values())
    rows.sort(key=lambda r: ((r["doc_id"] * 2654435761) % (1 << 32), r["doc_id"], r["parts"], r["lang"] or ""))
    width = 1 + len(BEGINNINGS)
    every = np.frombuffer(b"".join(r["parts"] for r in rows), "<i4").reshape(-1, width)
    sizes = [len(r["parts"]) // (4 * width) for r in rows]
    codes, _ = pd.factorize(ranges_of_rows(every)) if len(every) else (np.zeros(0, np.int64), None)
    parts = np.zeros((int(codes.max()) + 1 if len(codes) else 0, width), np.int32)
    parts[codes] = every
    texts = np.split(codes, np.cumsum(sizes)[:-1]) if rows else []
    return train(texts, parts, np.array([int(r["toxic"] > 0) for r in rows], np.float32), [r["lang"] for r in rows])


def ranges_of_rows(rows: np.ndarray) -> np.ndarray:
    """A fingerprint of each row of small numbers."""
    out = np.zeros(len(rows), np.uint64)
    for column in rows.T:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + column.astype(np.uint64))
    return out


def score(df: DataFrame, model: Model, text: str = "text", lang: str | None = "lang") -> DataFrame:
    """df's columns with toxicity (0 to 1), threshold and toxic_flag.

    Only the text enters the score; lang picks the threshold it is held against.  Null and empty texts score as a text
    without words.  Columns of these names in df are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    made = ("toxicity", "threshold", "toxic_flag")
    df = df.drop(*made)
    names, at = df.columns, df.columns.index(text)
    by = df.columns.index(lang) if lang in df.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches):
            for first, last, texts in text_chunks(batch.column(at)):
                found = scores(model, read_words(texts))
                langs = batch.column(by)[first:last].to_pylist() if by is not None else [""] * (last - first)
                limit = np.array([model.thresholds.get(x or "", model.thresholds.get("", 0.5)) for x in langs])
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found), pa.array(limit), pa.array(found >= limit)], [*names, *made])

    fields = [T.StructField("toxicity", T.DoubleType()), T.StructField("threshold", T.DoubleType()), T.StructField("toxic_flag", T.BooleanType())]
    return in_batches(df, run, T.StructType([*df.schema.fields, *fields]))


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = fit(docs, labels.where(~held_out()))
    found = score(docs.select("doc_id", "text", "lang"), model)
    return found.select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
        "threshold",
        "toxic_flag",
    )
