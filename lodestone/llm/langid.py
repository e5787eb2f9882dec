"""Language identification by fusing evidence.

The posterior of a row's language is proportional to the likelihood of its text under letter trigrams, of the language
it declares, and of its address suffix, times a prior of its host.  Host priors are Dirichlet-smoothed in steps: a host
leans on its site, a site on its suffix, a suffix on the whole.  All tables are grouped aggregations over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches, let, materialize, read
from .textkit import LETTER, classes, code_points, mix, segment, slices, text_chunks

BUCKETS = 1 << 15
#: Counts that a task holds before it hands them on.
HELD_COUNTS = 1 << 20
#: Pseudo-counts that a host, site and suffix give to the level above, and the weight of text against hints.
HOST_LEANS = SITE_LEANS = SUFFIX_LEANS = 5.0
#: A text with so many trigrams counts fully for the hints' tables, a shorter one in proportion.
CLEAR_TRIGRAMS = 10
#: The log-likelihood of a text is scaled down to this many trigrams, as neighbouring trigrams aren't independent.
EFFECTIVE_TRIGRAMS = 40.0
#: Numbers that the hosts' priors are broadcast with at most; larger tables are joined by a shuffle.
MAX_BROADCAST_NUMBERS = 1_000_000
UNKNOWN = "und"
#: A row is rejected if its language is unknown or its posterior is below this.
MIN_POSTERIOR = 0.5
#: How much better letters at random must fit, in the scaled log-likelihood, for a text to be in no known language.
#: A language with so few trigrams that no text could fit it that badly must fit better than letters at random by as much.
UNKNOWN_MARGIN = 4.0


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams of letters, with word bounds as blanks, of all texts, and each text's bounds."""
    points, bounds = code_points([" " + t.lower() + " " for t in texts])
    letter = classes()[points] == LETTER
    value = np.where(letter, points, 32).astype(np.uint64)
    if len(value) < 3:
        return np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    keep = letter[1:-1].copy()
    key = (value[:-2] << np.uint64(42)) | (value[1:-1] << np.uint64(21)) | value[2:]
    at = np.flatnonzero(keep)
    return (mix(key[at]) >> np.uint64(64 - 15)).astype(np.int64), np.searchsorted(at + 1, bounds)


def declared_languages(df: DataFrame, declared: str) -> list[str]:
    """Every language that a row declares, however few do."""
    said = F.col(declared).cast("string")
    return sorted(r[0] for r in df.where(F.trim(said) != "").select(said).distinct().collect())


def trigram_counts(df: DataFrame, languages: list[str], text: str, declared: str) -> np.ndarray:
    """languages x BUCKETS counts over all declared rows.

    Each task adds up counts by language and bucket; what reaches the driver is at most languages x BUCKETS sums.
    """
    place = {x: k for k, x in enumerate(languages)}

    def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        found, at = np.unique(np.concatenate(keys), return_inverse=True)
        return found, np.bincount(at, np.concatenate(counts), len(found)).astype(np.int64)

    def handed(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for first in range(0, len(keys), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[first : first + 50_000]), pa.array(counts[first : first + 50_000])], ["key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for batch in slices(batches):
            names = batch.column(1).to_pylist()
            for first, last, texts in text_chunks(batch.column(0)):
                ids, bounds = trigrams(texts)
                lang = np.array([place.get(x, -1) for x in names[first:last]], np.int64)
                lang = np.repeat(lang, np.diff(bounds))
                known = lang >= 0
                key, n = np.unique(lang[known] * BUCKETS + ids[known], return_counts=True)
                keys.append(key)
                counts.append(n)
                held += len(key)
                if held > HELD_COUNTS:
                    key, n = merged(keys, counts)
                    if len(key) > HELD_COUNTS // 2:
                        yield from handed(key, n)
                        key, n = key[:0], n[:0]
                    keys, counts, held = [key], [n], len(key)
        yield from handed(*merged(keys, counts))

    parts = in_batches(df.select(F.col(text).cast("string"), F.col(declared).cast("string")), run, "key long, n long")
    sums = parts.groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(languages), BUCKETS))
    counts.ravel()[sums.column("key").to_numpy()] = sums.column("n").to_numpy()
    return counts


def trigram_table(counts: np.ndarray) -> np.ndarray:
    """languages x BUCKETS log-probabilities, smoothed by 0.5."""
    counts = counts + 0.5
    return np.log(counts / counts.sum(1, keepdims=True))


def text_evidence(df: DataFrame, table: np.ndarray, text: str) -> DataFrame:
    """df with __text_loglik and __n_trigrams: for each language, and last for a text in none, the scaled log-likelihood of the text."""
    shared = df.sparkSession.sparkContext.broadcast(np.vstack([table, np.full(BUCKETS, -np.log(BUCKETS))]).T.astype(np.float32))
    names, at = df.columns, df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in slices(batches):
            for first, last, texts in text_chunks(batch.column(at)):
                ids, bounds = trigrams(texts)
                sums = np.column_stack([segment(np.add, table[ids, k].astype(np.float64), bounds, 0.0) for k in range(table.shape[1])])
                n = np.diff(bounds)[:, None]
                sums *= np.minimum(1.0, EFFECTIVE_TRIGRAMS / np.maximum(n, 1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1) * sums.shape[1], pa.int32()), pa.array(sums.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.slice(first, last - first).columns, lists, pa.array(n[:, 0], pa.int64())], [*names, "__text_loglik", "__n_trigrams"])

    made = [T.StructField("__text_loglik", T.ArrayType(T.DoubleType())), T.StructField("__n_trigrams", T.LongType())]
    return in_batches(df, run, T.StructType([*df.schema.fields, *made]))


def _softmax(values: Column) -> Column:
    def shares(powers: Column) -> Column:
        return let(F.aggregate(powers, F.lit(0.0), lambda a, y: a + y), lambda total: F.transform(powers, lambda x: x / total))

    return let(values, lambda v: let(F.array_max(v), lambda top: let(F.transform(v, lambda x: F.exp(x - top)), shares)))


def _shares(df: DataFrame, key: str, n: int) -> DataFrame:
    """(key, mass): the sums of the rows' text posteriors, and only partial sums are shuffled."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*(F.sum(F.col("__p")[k]).alias(f"m{k}") for k in range(n))).select(key, F.array(*(f"m{k}" for k in range(n))).alias("mass"))


def _lean(mass: Column, above: Column, weight: float) -> Column:
    total = F.aggregate(mass, F.lit(0.0), lambda a, x: a + x)
    return let(total, lambda all_: F.zip_with(mass, above, lambda m, p: (m + weight * p) / (all_ + weight)))


def host_levels(host: Column) -> dict[str, Column]:
    """A host, its site (last two labels) and its suffix (last label); nulls for an empty host."""
    labels = F.split(host, r"\.")
    known = host.isNotNull() & (host != "")
    return {
        "__host": F.when(known, host),
        "__site": F.when(known, F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), ".")),
        "__suffix": F.when(known, F.element_at(labels, -1)),
    }


def identify(df: DataFrame, text: str = "text", declared: str = "lang", host: Column | None = None, train: DataFrame | None = None, keep_text: bool = True) -> DataFrame:
    """df with language, language_posterior, text_language and language_rejected.

    declared names the column with a row's declared language (it may be null or wrong), host an expression of its host.
    Trigrams are counted on train, which has the same two columns (default: df itself).  A text without letters, null
    texts included, carries no text evidence: its language is 'und' and it is rejected.  So is a text that fits no
    language better than letters at random.  With no declared language at all every row is 'und'.  Of languages with equal
    posteriors the first by name is taken.  Rows that are repeated count each time and come back each time.  Texts are read
    whole, one row at a time.  An empty table gives no rows.  With keep_text=False the text column is left out, and the
    evidence is written down once instead of worked out again for the result.
    """
    made = ("language", "language_posterior", "text_language", "language_rejected")
    df = df.drop(*made)
    columns = [c for c in df.columns if keep_text or c != text]
    source = df if train is None else train
    languages = declared_languages(source, declared)
    n = len(languages)
    if not n:
        return df.select(*columns, F.lit(UNKNOWN).alias(made[0]), F.lit(0.0).alias(made[1]), F.lit(UNKNOWN).alias(made[2]), F.lit(True).alias(made[3]))
    counts = trigram_counts(source, languages, text, declared)
    refutable = EFFECTIVE_TRIGRAMS * np.log1p(counts.sum(1) / (0.5 * BUCKETS)) >= UNKNOWN_MARGIN
    table = trigram_table(counts)
    said = F.col(declared).cast("string")
    names = F.array(*map(F.lit, languages))
    given = df if host is None else df.withColumn("__given_host", host)
    rows = text_evidence(given, table, text)
    host = None if host is None else F.col("__given_host")
    if not keep_text:
        rows = materialize(rows.drop(text), "language-rows")
    flat = F.slice("__text_loglik", F.lit(1), F.lit(n))
    rows = rows.withColumn("__p", _softmax(flat)).withColumns(host_levels(host if host is not None else F.lit(None).cast("string")))
    rows = rows.withColumn("__said", F.when(F.array_contains(names, said), said))

    # The hints' tables have a row for each host, site, suffix or language; short texts weigh less, those without letters nothing.
    weight = F.least(F.lit(1.0), F.col("__n_trigrams") / CLEAR_TRIGRAMS)
    clear = rows.select(F.transform("__p", lambda x: x * weight).alias("__p"), "__host", "__site", "__suffix", "__said")
    clear = materialize(clear, "language-evidence")
    whole = clear.agg(*(F.sum(F.col("__p")[k]).alias(f"m{k}") for k in range(n))).collect()[0]
    mass = np.array([x or 0.0 for x in whole]) + 1.0
    top = F.array(*(F.lit(float(x)) for x in mass / mass.sum()))
    even = F.array(*(F.lit(1.0 / n) for _ in range(n)))
    speak = {r[0]: np.array(r[1]) for r in _shares(clear, "__said", n).collect()}
    # chances of declaring what was declared, for each true language
    tables = np.array([speak.get(x, np.zeros(n)) for x in languages]) + 0.5
    chance = np.log(tables / tables.sum(0, keepdims=True))
    declares = df.sparkSession.createDataFrame([(name, chance[k].tolist()) for k, name in enumerate(languages)], "__said string, __hint array<double>")
    suffixes = _shares(clear, "__suffix", n).select("__suffix", _lean(F.col("mass"), top, SUFFIX_LEANS).alias("__suffix_prior"))
    sites = _shares(clear, "__site", n).withColumn("__suffix", F.substring_index("__site", ".", -1)).join(suffixes, "__suffix", "left")
    sites = sites.select("__site", _lean(F.col("mass"), F.col("__suffix_prior"), SITE_LEANS).alias("__site_prior"))
    hosts = _shares(clear, "__host", n).withColumn("__site", host_levels(F.col("__host"))["__site"]).join(sites, "__site", "left")
    hosts = materialize(hosts.select("__host", F.col("mass").alias("__mass"), "__site_prior"), "hosts")
    few = hosts.limit(MAX_BROADCAST_NUMBERS // (2 * n) + 1).count() <= MAX_BROADCAST_NUMBERS // (2 * n)

    # rows without a host meet none, but not all in one task
    rows = rows.withColumn("__host", F.coalesce("__host", F.concat(F.lit("\0"), F.xxhash64("__text_loglik").cast("string"))))
    rows = rows.join(F.broadcast(hosts) if few else hosts, "__host", "left").join(F.broadcast(declares), "__said", "left")
    # a row's own text is evidence already: its share of the host's mass doesn't count again
    others = F.zip_with("__mass", "__p", lambda m, x: F.greatest(m - x * weight, F.lit(0.0))) if train is None else F.col("__mass")
    prior = F.coalesce(_lean(others, F.col("__site_prior"), HOST_LEANS), F.when(F.lit(host is None), even), top)
    hint = F.coalesce("__hint", F.transform(even, lambda x: F.lit(0.0)))
    fused = F.zip_with(F.zip_with(flat, hint, lambda a, b: a + b), F.transform(prior, lambda x: F.ln(x)), lambda a, b: a + b)
    rows = rows.withColumn("__posterior", _softmax(fused))
    best = F.array_max("__posterior")
    margins = F.array(*(F.lit(UNKNOWN_MARGIN if x else -UNKNOWN_MARGIN) for x in refutable))
    foreign = (F.col("__n_trigrams") == 0) | (F.array_max(F.zip_with(flat, margins, lambda a, m: a + m)) < F.element_at("__text_loglik", -1))
    found = F.when(foreign, UNKNOWN).otherwise(F.element_at(names, F.array_position("__posterior", best).cast("int")))
    rows = rows.withColumns(
        {
            "language": found,
            "language_posterior": F.when(foreign, 0.0).otherwise(best),
            "text_language": F.when(foreign, UNKNOWN).otherwise(F.element_at(names, F.array_position("__p", F.array_max("__p")).cast("int"))),
        }
    )
    rows = rows.withColumn("language_rejected", (F.col("language") == UNKNOWN) | (F.col("language_posterior") < MIN_POSTERIOR))
    return rows.select(*columns, *made)


def visible_text(html: Column) -> Column:
    """What a reader of a page sees, near enough for counting trigrams."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|nav)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*+>", " "), r"&#?[A-Za-z0-9]{1,10};", " ")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import url_parts

    pages = url_parts(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    declared = F.lower(F.regexp_extract("html", r"""(?is)<html\b[^>]*\blang\s*=\s*["']?([a-z]{2,3})""", 1))
    pages = pages.select("page_id", "host", F.nullif(declared, F.lit("")).alias("declared"), visible_text(F.col("html")).alias("text"))
    found = identify(pages, "text", "declared", F.col("host"), keep_text=False)
    return found.select("page_id", "host", "declared", "language", F.round("language_posterior", 6).alias("posterior"), "text_language", F.col("language_rejected").alias("rejected"))
