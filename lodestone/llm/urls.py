"""URL verdicts: rules for hosts and paths, and for the rest gradient-boosted trees over lexical features.

Features, suffix statistics, training and scoring are DataFrame and JVM ML operations; no Python runs on executors.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, materialize, read

#: (verdict, host, path): fixed rules of the url query.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
FEATURES = ("length", "host_length", "path_length", "depth", "host_depth", "digit_ratio", "entropy", "host_entropy", "n_params", "n_hyphens", "longest_label", "has_fragment", "suffix_share", "suffix_blocked")
#: Labelled rows the trees are fitted on at most, taken by a hash of the url.
MAX_TRAIN_ROWS = 50_000
#: Suffixes whose statistics are broadcast, the most frequent ones; those of rarer suffixes are joined by a shuffle.
MAX_SUFFIXES = 2_000


def url_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """df with host (A-Z lower-cased) and path; both empty for a null url or one without ://."""
    known = F.coalesce(F.col(url), F.lit(""))
    rest = F.when(F.contains(known, F.lit("://")), F.regexp_extract(known, r"(?s)^.*?://(.*)$", 1)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return df.withColumns({"host": host, "path": path})


def rule_columns(rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits host and path, else nulls; a tie goes to the longer host."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, host, path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit(f".{host}"))) & F.startswith(F.col("path"), F.lit(path))
        rule, verdict = F.when(fits, f"{host}{path}").otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def _entropy(text: Column) -> Column:
    """Bits a character, from the runs of the sorted characters."""

    def bits(chars: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(chars) - 1), lambda i: (i == 0) | (F.get(chars, i) != F.get(chars, i - 1)))
        shares = let(starts, lambda s: F.transform(s, lambda at, k: (F.coalesce(F.get(s, k + 1), F.size(chars)) - at) / F.size(chars)))
        return F.when(F.size(chars) == 0, 0.0).otherwise(F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(p)))

    return let(F.sort_array(F.filter(F.split(text, ""), lambda c: c != "")), bits)


def lexical_features(df: DataFrame, url: str = "url") -> DataFrame:
    """df, which has host and path, with the url's own features and its host's suffix."""
    text = F.coalesce(F.col(url), F.lit(""))
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    labels = F.split("host", r"\.")
    return df.withColumns(
        {
            "length": F.length(text).cast("double"),
            "host_length": F.length("host").cast("double"),
            "path_length": F.length("path").cast("double"),
            "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double"),
            "host_depth": F.size(labels).cast("double"),
            "digit_ratio": F.length(F.regexp_replace(text, "[^0-9]", "")) / F.greatest(F.length(text), F.lit(1)),
            "entropy": _entropy(text),
            "host_entropy": _entropy(F.col("host")),
            "n_params": F.size(F.filter(F.split(query, "&"), lambda x: x != "")).cast("double"),
            "n_hyphens": (F.length("host") - F.length(F.replace(F.col("host"), F.lit("-"), F.lit("")))).cast("double"),
            "longest_label": F.array_max(F.transform(labels, lambda x: F.length(x))).cast("double"),
            "has_fragment": F.contains(text, F.lit("#")).cast("double"),
            "suffix": F.element_at(labels, -1),
        }
    )


def suffix_statistics(df: DataFrame, most: int = MAX_SUFFIXES) -> tuple[DataFrame, DataFrame | None, float]:
    """(frequent, rare, prior): for every host suffix its share of all urls and its smoothed share of blocked labelled ones.

    frequent has the most frequent suffixes, rare the others, or is None without others; prior is the share of blocked
    urls for a suffix that df doesn't have.
    """
    each = df.groupBy("suffix").agg(F.count("*").alias("n"), F.count("label").alias("labelled"), F.sum("label").alias("blocked"))
    each = materialize(each, "suffixes")
    total = each.agg(F.count("*").alias("suffixes"), F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")).first()
    prior = ((total.blocked or 0.0) + 1) / ((total.labelled or 0) + 2)
    shares = ("suffix", (F.col("n") / max(1, total.n or 0)).alias("suffix_share"), ((F.coalesce(F.col("blocked"), F.lit(0.0)) + 10 * prior) / (F.col("labelled") + 10)).alias("suffix_blocked"))
    if total.suffixes <= most:
        return each.select(*shares), None, prior
    frequent = each.orderBy(F.desc("n"), "suffix").limit(most)
    return frequent.select(*shares), each.join(F.broadcast(frequent), "suffix", "left_anti").select(*shares), prior


def train(labelled: DataFrame, max_rows: int = MAX_TRAIN_ROWS, url: str = "url", trees: int = 8, depth: int = 4) -> PipelineModel | None:
    """Trees for label (1: block, 0: allow), or None unless both labels occur.  Rows over max_rows are left out by hash."""
    rows = labelled.where("label is not null").orderBy(F.xxhash64(url), url).limit(max_rows).select(*FEATURES, "label").coalesce(2).persist()
    try:
        if rows.select("label").distinct().count() < 2:
            return None
        assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
        fitted = GBTClassifier(labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7).fit(assembled.transform(rows))
        return PipelineModel([assembled, fitted])
    finally:
        rows.unpersist()


def judge(df: DataFrame, rules=RULES, labels: DataFrame | None = None, url: str = "url") -> DataFrame:
    """df with host, path, rule, verdict and block_probability.

    A rule's verdict stands.  Other urls get the trees' verdict, fitted on labels (url, label: 1 block, 0 allow) or, by
    default, on the urls that a rule decides.  With no labels of both kinds every other url is allowed.  Null, empty
    and odd urls have an empty host and path and are judged by their features like any other.  Equal urls get equal verdicts,
    however often they occur; a probability of exactly a half blocks.  Urls are read whole, whatever their length.
    """
    made = ("host", "path", "rule", "verdict", "block_probability")
    rule, verdict = rule_columns(rules)
    rows = df.drop(*made).select(F.struct("*").alias("__row"), F.col(url).alias("__url"))
    rows = url_parts(rows, "__url").withColumns({"rule": rule, "__said": verdict})
    rows = lexical_features(rows.withColumn("label", F.when(F.col("__said") == "block", 1.0).when(F.col("__said") == "allow", 0.0)), "__url")
    train_rows = rows if labels is None else lexical_features(url_parts(labels.select(F.col(url).alias("__url"), "label"), "__url"), "__url")
    suffixes = suffix_statistics(train_rows)
    model = train(_with_suffix(train_rows, suffixes), url="__url")
    rows = _with_suffix(rows, suffixes)
    if model is None:
        rows = rows.withColumn("block_probability", F.lit(0.0))
    else:
        rows = model.transform(rows).withColumn("block_probability", vector_to_array("probability")[1])
    rows = rows.withColumn("verdict", F.coalesce("__said", F.when(F.col("block_probability") >= 0.5, "block").otherwise("allow")))
    return rows.select("__row.*", *made)


def _with_suffix(df: DataFrame, statistics: tuple[DataFrame, DataFrame | None, float]) -> DataFrame:
    """df with the statistics of its suffixes; rows of frequent suffixes are dealt out by url where rare ones are joined."""
    frequent, rare, prior = statistics
    out = df.join(F.broadcast(frequent), "suffix", "left")
    if rare is not None:
        # no suffix holds a dot, so the keys of rows that have their statistics meet nothing
        key = F.when(F.col("suffix_share").isNull(), F.col("suffix")).otherwise(F.concat(F.lit("."), F.xxhash64("__url").cast("string")))
        others = rare.select(F.col("suffix").alias("__key"), F.col("suffix_share").alias("__share"), F.col("suffix_blocked").alias("__blocked"))
        out = out.withColumn("__key", key).join(others, "__key", "left")
        out = out.withColumns({"suffix_share": F.coalesce("suffix_share", "__share"), "suffix_blocked": F.coalesce("suffix_blocked", "__blocked")}).drop("__key", "__share", "__blocked")
    return out.fillna({"suffix_share": 0.0, "suffix_blocked": prior})


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict", F.round("block_probability", 6).alias("block_probability"))
