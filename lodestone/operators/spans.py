"""The span algebra: expressions of words as sets of spans over a token array.

A span is {s, e}: first and last token, counted from 1.  A document matches an expression with at least one span.
Everything is higher-order functions over the tokens, so matching needs no shuffle.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidQueryError
from ..functions.analysis import fold_text, query_tokens
from ..functions.jsonpath import let

Test = Callable[[Column], Column]


def nothing() -> Column:
    return F.array().cast("array<struct<s:int,e:int>>")


def span(s: Column, e: Column) -> Column:
    return F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"))


def word_test(word: str) -> Test:
    return lambda x: x == word


def fuzzy_test(word: str, distance: int = 1, prefix: int = 1) -> Test:
    if distance < 0 or prefix < 0:
        raise InvalidQueryError("distance and prefix start at 0")
    head = word[:prefix]
    near = lambda x: F.levenshtein(x, F.lit(word), distance) >= 0
    return (lambda x: x.startswith(head) & (F.length(x) >= len(head)) & near(x)) if head else near


def wildcard_test(pattern: str) -> Test:
    body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in fold_text(pattern))
    return lambda x: x.rlike(f"(?s)^{body}$")


def regex_test(pattern: str) -> Test:
    return lambda x: x.rlike(f"(?s)^(?:{pattern})$")


def range_test(low: str | None, high: str | None) -> Test:
    def test(x: Column) -> Column:
        parts = ([x >= fold_text(low)] if low is not None else []) + ([x <= fold_text(high)] if high is not None else [])
        return functools.reduce(lambda a, b: a & b, parts) if parts else F.lit(True)

    return test


@dataclass
class Node:
    """An expression: how its spans follow from tokens, its words for scoring, and its factor."""

    spans: Callable[[Column], Column]
    leaves: list[Node] = field(default_factory=list)
    factor: float = 1.0
    boosted: bool = False
    #: Whether a document matches and how often, where that takes no spans.
    quick: Callable[[Column], Column] | None = None
    tally: Callable[[Column], Column] | None = None
    #: Groups of tests: a document that matches holds, for each group, a token that passes one of its tests.  None: unknown.
    needs: list[list[Test]] | None = None
    #: All tests of tokens that the expression makes, of what it excludes too.
    tests: list[Test] = field(default_factory=list)
    #: Whether the places of tokens matter, or only which there are and how often.
    positional: bool = True

    def words(self) -> list[Node]:
        return self.leaves or [self]

    def hit(self, tokens: Column) -> Column:
        # tokens may hold nulls, which pass no test
        return F.coalesce(self.quick(tokens), F.lit(False)) if self.quick else F.size(self.spans(tokens)) > 0

    def count(self, tokens: Column) -> Column:
        return self.tally(tokens) if self.tally else F.size(self.spans(tokens))


def token_node(test: Test, word: str | None = None) -> Node:
    """One token; a plain word is looked up without a lambda."""

    def spans(tokens: Column) -> Column:
        return F.filter(F.transform(tokens, lambda x, i: F.when(test(x), span(i + 1, i + 1))), lambda x: x.isNotNull())

    quick = (lambda tokens: F.array_contains(tokens, F.lit(word))) if word is not None else (lambda tokens: F.exists(tokens, test))
    return Node(spans, quick=quick, tally=lambda tokens: F.size(F.filter(tokens, test)), needs=[[test]], tests=[test], positional=False)


def plain_node(word: str) -> Node:
    return token_node(word_test(word), word)


def phrase_node(slots: list[Test | None], slop: int = 0) -> Node:
    if len(slots) == 1 and slots[0]:
        return token_node(slots[0])

    def exact(tokens: Column) -> Column:
        n = len(slots)

        def at(i: Column) -> Column:
            tests = [F.coalesce(t(F.get(tokens, i + (k - 1))), F.lit(False)) for k, t in enumerate(slots) if t]
            return functools.reduce(lambda a, b: a & b, tests) if tests else F.lit(True)

        starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(F.filter(starts, at), lambda i: span(i, i + (n - 1)))

    def loose(tokens: Column) -> Column:
        found = None
        for k, test in enumerate(slots):
            one = token_node(test or (lambda x: F.lit(True))).spans(tokens)
            if found is None:
                found = one
                continue

            def extended(a: Column, places: Column, k=k) -> Column:
                fits = F.filter(places, lambda p: (p["s"] > a["e"]) & (p["s"] - a["s"] - k <= slop))
                return F.transform(fits, lambda p: span(a["s"], p["e"]))

            def joined(left: Column, places: Column, step=extended) -> Column:
                return let(places, lambda held: F.flatten(F.transform(left, lambda a: step(a, held))))

            found = joined(found, one)
        return found

    return Node(loose if slop else exact, needs=[[t] for t in slots if t] or None, tests=[t for t in slots if t])


def _both(*nodes: Node) -> list[list[Test]] | None:
    known = [n.needs for n in nodes if n.needs is not None]
    return [group for groups in known for group in groups] if known else None


def _either(nodes: list[Node]) -> list[list[Test]] | None:
    if any(n.needs is None for n in nodes):
        return None
    return [[test for n in nodes for test in (min(n.needs, key=len) if n.needs else [])]]


def pairs(left: Node, right: Node, make: Callable[[Column, Column], Column], keep: Callable[[Column, Column], Column]) -> Node:
    def spans(tokens: Column) -> Column:
        def crossed(b: Column) -> Column:
            return F.flatten(F.transform(left.spans(tokens), lambda x: F.transform(F.filter(b, lambda y: keep(x, y)), lambda y: make(x, y))))

        return F.array_distinct(let(right.spans(tokens), crossed))

    return Node(spans, left.words() + right.words(), needs=_both(left, right), tests=left.tests + right.tests)


def near_node(items: list[Node], distance: int, ordered: bool) -> Node:
    def make(a: Column, b: Column) -> Column:
        return span(F.least(a["s"], b["s"]), F.greatest(a["e"], b["e"]))

    def keep(a: Column, b: Column) -> Column:
        after = (b["s"] > a["e"]) & (b["s"] - a["e"] - 1 <= distance)
        return after if ordered else after | ((a["s"] > b["e"]) & (a["s"] - b["e"] - 1 <= distance))

    return functools.reduce(lambda x, y: pairs(x, y, make, keep), items)


def related(left: Node, right: Node, test: Callable[[Column, Column], Column], wanted: bool = True) -> Node:
    def spans(tokens: Column) -> Column:
        def kept(b: Column) -> Column:
            return F.filter(left.spans(tokens), lambda x: F.exists(b, lambda y: test(x, y)) if wanted else ~F.exists(b, lambda y: test(x, y)))

        return let(right.spans(tokens), kept)

    return Node(spans, left.words(), needs=_both(left, right) if wanted else left.needs, tests=left.tests + right.tests)


RELATIONS: dict[str, Callable[[Column, Column], Column]] = {
    "encloses": lambda a, b: (a["s"] <= b["s"]) & (b["e"] <= a["e"]),
    "enclosed_by": lambda a, b: (b["s"] <= a["s"]) & (a["e"] <= b["e"]),
    "overlapping": lambda a, b: (a["s"] <= b["e"]) & (b["s"] <= a["e"]),
    "before": lambda a, b: a["e"] < b["s"],
    "after": lambda a, b: a["s"] > b["e"],
}


def kept_spans(inner: Node, keep: Callable[[Column, Column], Column]) -> Node:
    """The spans for which keep(span, number of tokens) holds."""
    return Node(lambda tokens: let(F.size(tokens), lambda n: F.filter(inner.spans(tokens), lambda x: keep(x, n))), inner.words(), needs=inner.needs, tests=inner.tests)


def at_least_node(items: list[Node], needed: int) -> Node:
    def spans(tokens: Column) -> Column:
        if len(items) == 1:
            return items[0].spans(tokens)

        def chosen(lists: Column) -> Column:
            hits = F.size(F.filter(lists, lambda x: F.size(x) > 0))
            return F.when(hits >= needed, F.flatten(lists)).otherwise(nothing())

        return let(F.array(*(i.spans(tokens) for i in items)), chosen)

    def quick(tokens: Column) -> Column:
        hits = [i.hit(tokens) for i in items]
        if needed >= len(items):
            return functools.reduce(lambda a, b: a & b, hits) if needed == len(items) else F.lit(False)
        if needed == 1:
            return functools.reduce(lambda a, b: a | b, hits)
        return functools.reduce(lambda a, b: a + b, [h.cast("int") for h in hits]) >= needed

    needs = _both(*items) if needed >= len(items) else _either(items)
    return Node(spans, [w for i in items for w in i.words()], quick=quick, needs=needs, tests=[t for i in items for t in i.tests], positional=any(i.positional for i in items))


def but_not_node(left: Node, right: Node) -> Node:
    return Node(lambda tokens: F.when(~right.hit(tokens), left.spans(tokens)).otherwise(nothing()), left.words(), quick=lambda tokens: left.hit(tokens) & ~right.hit(tokens), needs=left.needs, tests=left.tests + right.tests)


def all_node() -> Node:
    return Node(lambda tokens: F.array(span(F.lit(1), F.greatest(F.size(tokens), F.lit(1)))), [none_node()], quick=lambda tokens: F.lit(True))


def none_node() -> Node:
    return Node(lambda tokens: nothing(), quick=lambda tokens: F.lit(False), tally=lambda tokens: F.lit(0), needs=[[]], positional=False)


def boosted(inner: Node, factor: float) -> Node:
    words = [replace(w, leaves=[], factor=w.factor * factor, boosted=True) for w in inner.words()]
    return replace(inner, leaves=words, factor=inner.factor * factor, boosted=True)


def text_node(text: str) -> Node:
    """A word or phrase given as text; text without words matches nothing."""
    words = query_tokens(text)
    if len(words) == 1:
        return plain_node(words[0])
    return phrase_node([word_test(w) for w in words]) if words else none_node()


def share(n: int, percent: float) -> int:
    """How many of n a percentage asks for: rounded up, at least 1."""
    return max(1, math.ceil(n * percent / 100))
