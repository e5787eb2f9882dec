"""BM25 over the words of an expression, with statistics of the whole index."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spans import Node

K1, B = 1.2, 0.75
#: Words that stand in this share of all documents or more add nothing to a score, unless they are boosted.
DENSE = 0.10


@dataclass(frozen=True)
class Statistics:
    """How many documents there are, their mean length, and how many hold each word of an expression."""

    documents: int
    mean_length: float
    frequencies: tuple[int, ...]


def idf(documents: int, holding: int) -> float:
    return math.log(1 + (documents - holding + 0.5) / (holding + 0.5))


def elided(word: Node, holding: int, documents: int) -> bool:
    return not word.boosted and documents > 0 and holding / documents >= DENSE


def bm25(words: list[Node], tokens: Column, length: Column, found: Statistics, elide: bool, k1: float = K1, b: float = B) -> Column:
    """The sum over words of idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean)).

    Each word of the expression counts as one term, however many spellings it takes in.
    """
    length = length.cast("double")
    total = F.lit(0.0)
    for word, holding in zip(words, found.frequencies, strict=True):
        if elide and elided(word, holding, found.documents):
            continue
        tf = word.count(tokens).cast("double")
        weight = idf(found.documents, holding) * word.factor
        total = total + F.lit(weight) * tf * (k1 + 1) / (tf + F.lit(k1) * (1 - b + b * length / F.lit(found.mean_length or 1.0)))
    return total
