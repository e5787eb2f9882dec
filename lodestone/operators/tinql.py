"""Span-query expressions: nested dictionaries, their printed form, and the printed form read back.

compiled(expression) gives (text, Node).  A plain string is a literal word or phrase, a dictionary holds one operator.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from ..errors import InvalidQueryError
from ..functions.analysis import fold_text, query_tokens
from . import spans as S
from .spans import Node

#: Options that each operator takes besides its operand (fixed values).
OPTIONS = {
    "term": (), "all": (), "wildcard": (), "matches": (), "range": (), "fuzzy": ("distance", "prefix"), "phrase": ("slop",), "near": ("distance",), "then": ("distance",),
    "within": ("words",), "and": (), "or": (), "and_not": (), "any_of": (), "all_of": (), "at_least": ("count", "percent"), "encloses": (), "not_encloses": (), "enclosed_by": (),
    "not_enclosed_by": (), "overlapping": (), "not_overlapping": (), "before": (), "after": (), "in_first": ("words", "percent"), "in_last": ("words", "percent"), "in_middle": ("percent",),
    "in_words": ("from", "to"), "boost": ("factor",), "raw": (),
}


#: Words of the printed form that a plain word can't be (fixed values).
RESERVED = {"AND", "OR", "NOT", "NEAR", "THEN", "WITHIN", "OF", "IN", "ALL", "AT", "LEAST", "FIRST", "LAST", "MIDDLE", "WORDS", "CONTAINS", "MATCHES", "ENCLOSES", "ENCLOSED_BY", "OVERLAPPING", "BEFORE", "AFTER"}


def quoted(text: str) -> str:
    return '"' + re.sub(r'([\\"_\[\]])', r"\\\1", text) + '"'


def maybe_quote(text: str) -> str:
    """The text as it must stand in a printed expression: as it is if it is one plain word, else quoted."""
    return text if re.fullmatch(r"[^\W_]+", text) and text not in RESERVED else quoted(text)


def _integer(value, least: int) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < least:
        raise InvalidQueryError(f"a whole number from {least} on is needed, not {value!r}")
    return value


def _percent(value) -> int:
    if _integer(value, 1) > 100:
        raise InvalidQueryError(f"{value} is over 100 percent")
    return value


def _word(value) -> str:
    if not isinstance(value, str) or not value or re.search(r'[\s"()\[\]^~]', value):
        raise InvalidQueryError(f"{value!r} isn't one plain word")
    return value


def compiled(expression) -> tuple[str, Node]:
    if isinstance(expression, str):
        return quoted(expression), S.text_node(expression)
    names = [k for k in expression if k in OPTIONS] if isinstance(expression, dict) else []
    if len(names) != 1:
        raise InvalidQueryError(f"{expression!r} is neither a text nor a dictionary with one operator")
    name = names[0]
    options = {k: v for k, v in expression.items() if k != name}
    if unknown := set(options) - set(OPTIONS[name]):
        raise InvalidQueryError(f"{name} doesn't take {', '.join(sorted(unknown))}")
    return _OPERATORS[name](expression[name], options)


def _two(name: str, value) -> list:
    if not isinstance(value, (list, tuple)) or len(value) != 2:
        raise InvalidQueryError(f"{name} stands between two expressions")
    return list(value)


def _many(value) -> list[tuple[str, Node]]:
    if not isinstance(value, (list, tuple)) or not value:
        raise InvalidQueryError("a list of expressions is needed")
    return [compiled(v) for v in value]


def _listed(items) -> str:
    return "[" + " ".join(f"({text})" for text, _ in items) + "]"


def _phrase(value, options):
    slop = _integer(options["slop"], 0) if "slop" in options else 0
    ending = f"~{slop}" if slop else ""
    if isinstance(value, str):
        words = query_tokens(value)
        return quoted(value) + ending, S.phrase_node([S.word_test(w) for w in words], slop) if words else S.none_node()
    if not isinstance(value, (list, tuple)) or not value:
        raise InvalidQueryError("a phrase has words")
    texts, slots = [], []
    for part in value:
        if part is None:
            texts.append("_")
            slots.append(None)
        elif isinstance(part, (list, tuple)):
            texts.append("[" + " ".join(quoted(p)[1:-1] for p in part) + "]")
            slots.append(_one_of([w for p in part for w in query_tokens(p)]))
        else:
            texts.append(quoted(part)[1:-1])
            slots += [S.word_test(w) for w in query_tokens(part)]
    return '"' + " ".join(texts) + '"' + ending, S.phrase_node(slots, slop)


def _one_of(words: list[str]) -> S.Test:
    return lambda x: x.isin(*words) if words else x.isNull()


def _close(name: str, keyword: str):
    def build(value, options):
        sides = _two(name, value)
        distance = _integer(options.get("distance"), 0)
        (a, x), (b, y) = (compiled(s) for s in sides)
        return f"({a}) {keyword}/{distance} ({b})", S.near_node([x, y], distance, name == "then")

    return build


def _joined(name: str, keyword: str):
    def build(value, options):
        items = _many(_two(name, value) if name == "and_not" else value)
        text = f" {keyword} ".join(f"({t})" for t, _ in items)
        nodes = [n for _, n in items]
        if name == "and_not":
            return text, S.but_not_node(*nodes)
        return text, S.at_least_node(nodes, len(nodes) if name == "and" else 1)

    return build


def _group(keyword: str, all_needed: bool):
    def build(value, options):
        items = _many(value)
        return f"{keyword}{_listed(items)}", S.at_least_node([n for _, n in items], len(items) if all_needed else 1)

    return build


def _at_least(value, options):
    items = _many(value)
    if len(options) != 1:
        raise InvalidQueryError("at_least takes a count or a percent")
    if "count" in options:
        needed = _integer(options["count"], 1)
        said = str(needed)
    else:
        said = f"{_percent(options['percent'])}%"
        needed = S.share(len(items), options["percent"])
    return f"AT LEAST {said} OF {_listed(items)}", S.at_least_node([n for _, n in items], needed)


def _relation(name: str):
    keyword = name.upper().replace("_", " ")
    wanted = not name.startswith("not_")
    test = S.RELATIONS[name.removeprefix("not_")]

    def build(value, options):
        (a, x), (b, y) = (compiled(s) for s in _two(name, value))
        return f"({a}) {keyword} ({b})", S.related(x, y, test, wanted)

    return build


def positioned(name: str, inner: Node, words: int | None, percent: float | None) -> Node:
    part = None if percent is None else percent / 100
    if name == "in_first":
        return S.kept_spans(inner, lambda x, n: x["e"] <= (words if part is None else n * part))
    if name == "in_last":
        return S.kept_spans(inner, lambda x, n: x["s"] > n - (words if part is None else n * part))
    return S.kept_spans(inner, lambda x, n: (x["s"] > n * (1 - part) / 2) & (x["e"] <= n * (1 + part) / 2))


def _position(name: str):
    keyword = name.upper().replace("_", " ")

    def build(value, options):
        text, inner = compiled(value)
        if len(options) != 1:
            raise InvalidQueryError("a position takes words or percent")
        if "words" in options:
            n = _integer(options["words"], 1)
            return f"({text}) {keyword} {n} WORDS", positioned(name, inner, n, None)
        n = _percent(options["percent"])
        return f"({text}) {keyword} {n}%", positioned(name, inner, None, n)

    return build


def _in_words(value, options):
    text, inner = compiled(value)
    low, high = _integer(options.get("from"), 0), _integer(options.get("to"), 0)
    return f"({text}) IN WORDS {low} TO {high}", S.kept_spans(inner, lambda x, n: (x["s"] >= low) & (x["e"] <= high))


def _within(value, options):
    text, inner = compiled(value)
    n = _integer(options.get("words"), 1)
    return f"({text}) WITHIN {n}", S.kept_spans(inner, lambda x, _: x["e"] - x["s"] + 1 <= n)


def _boost(value, options):
    factor = options.get("factor")
    if isinstance(factor, bool) or not isinstance(factor, (int, float)) or not math.isfinite(factor) or not 0 <= factor <= 10_000:
        raise InvalidQueryError("factors lie between 0 and 10000")
    text, inner = compiled(value)
    return f"({text})^{factor}", S.boosted(inner, float(factor))


def _fuzzy(value, options):
    word = _word(value)
    distance, prefix = _integer(options.get("distance", 1), 0), _integer(options.get("prefix", 1), 0)
    return f"CONTAINS {word}~{prefix}:{distance}", S.token_node(S.fuzzy_test(fold_text(word), distance, prefix))


def _range(value, options):
    low, high = _two("range", value)
    texts = ["*" if v is None else _word(v) for v in (low, high)]
    return f"{texts[0]} TO {texts[1]}", S.token_node(S.range_test(low, high))


def _all(value, options):
    if value is not True:
        raise InvalidQueryError("all takes true")
    return "*", S.all_node()


def _literal(value, options):
    if not isinstance(value, str):
        raise InvalidQueryError("a text is needed")
    return quoted(value), S.text_node(value)


def _matches(value, options):
    if not isinstance(value, str) or re.search(r"\s", value):
        raise InvalidQueryError("matches takes a pattern without white space")
    return f"MATCHES {value}", S.token_node(S.regex_test(value))


_OPERATORS: dict[str, Callable] = {
    "term": _literal,
    "all": _all,
    "wildcard": lambda v, o: (f"CONTAINS {_word(v)}", S.token_node(S.wildcard_test(v))),
    "matches": _matches,
    "range": _range,
    "fuzzy": _fuzzy,
    "phrase": _phrase,
    "near": _close("near", "NEAR"),
    "then": _close("then", "THEN"),
    "within": _within,
    "and": _joined("and", "AND"),
    "or": _joined("or", "OR"),
    "and_not": _joined("and_not", "AND NOT"),
    "any_of": _group("", False),
    "all_of": _group("ALL OF ", True),
    "at_least": _at_least,
    **{n: _relation(n) for n in OPTIONS if n.removeprefix("not_") in S.RELATIONS},
    **{n: _position(n) for n in ("in_first", "in_last", "in_middle")},
    "in_words": _in_words,
    "boost": _boost,
    "raw": lambda v, o: (v, parsed(v)),
}


_LEX = re.compile(r'\s*("(?:[^"\\]|\\.)*"(?:~\d+)?|[()\[\]]|\^\d+(?:\.\d+)?|[^\s()\[\]"^]+)')
_RELATION_WORDS = {"ENCLOSES": "encloses", "ENCLOSED_BY": "enclosed_by", "OVERLAPPING": "overlapping", "BEFORE": "before", "AFTER": "after"}


class _Parser:
    """Reads the printed form: OR under AND and juxtaposition under span operators under boosts."""

    def __init__(self, text: str):
        self.words, at = [], 0
        while text[at:].strip():
            found = _LEX.match(text, at)
            if not found:
                raise InvalidQueryError(f"tinql can't be read at {text[at:]!r}")
            self.words.append(found[1])
            at = found.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> str:
        return self.words[self.at + ahead] if self.at + ahead < len(self.words) else ""

    def take(self, expected: str | None = None) -> str:
        word = self.peek()
        if not word or (expected and word != expected):
            raise InvalidQueryError(f"tinql expected {expected or 'more'}, not {word!r}")
        self.at += 1
        return word

    def either(self) -> Node:
        items = [self.both()]
        while self.peek() == "OR":
            self.take()
            items.append(self.both())
        return S.at_least_node(items, 1) if len(items) > 1 else items[0]

    def both(self) -> Node:
        left = self.related()
        while self.peek() and self.peek() not in ("OR", ")", "]"):
            if self.peek() == "AND":
                self.take()
                if self.peek() == "NOT":
                    self.take()
                    left = S.but_not_node(left, self.related())
                    continue
            left = S.at_least_node([left, self.related()], 2)
        return left

    def related(self) -> Node:
        left = self.factor()
        while word := self.peek():
            if close := re.fullmatch(r"(NEAR|THEN)/(\d+)", word):
                self.take()
                left = S.near_node([left, self.factor()], int(close[2]), close[1] == "THEN")
            elif word == "WITHIN":
                self.take()
                n = int(self.take())
                left = S.kept_spans(left, lambda x, _, n=n: x["e"] - x["s"] + 1 <= n)
            elif word == "IN":
                left = self.position(left)
            else:
                skip = 1 if word == "NOT" else 0
                name, length = self.peek(skip), 1
                if name == "ENCLOSED" and self.peek(skip + 1) == "BY":
                    name, length = "ENCLOSED_BY", 2
                if name not in _RELATION_WORDS:
                    return left
                self.at += skip + length
                left = S.related(left, self.factor(), S.RELATIONS[_RELATION_WORDS[name]], not skip)
        return left

    def position(self, left: Node) -> Node:
        self.take("IN")
        kind = self.take()
        n = self.take()
        if kind == "WORDS":
            self.take("TO")
            low, high = int(n), int(self.take())
            return S.kept_spans(left, lambda x, _: (x["s"] >= low) & (x["e"] <= high))
        if kind not in ("FIRST", "LAST", "MIDDLE"):
            raise InvalidQueryError(f"tinql has no position {kind!r}")
        if n.endswith("%"):
            return positioned(f"in_{kind.lower()}", left, None, int(n[:-1]))
        self.take("WORDS")
        return positioned(f"in_{kind.lower()}", left, int(n), None)

    def factor(self) -> Node:
        node = self.atom()
        while self.peek().startswith("^"):
            node = S.boosted(node, float(self.take()[1:]))
        return node

    def group(self) -> list[Node]:
        self.take("[")
        items = []
        while self.peek() != "]":
            items.append(self.related())
        self.take("]")
        if not items:
            raise InvalidQueryError("tinql groups hold at least one expression")
        return items

    def atom(self) -> Node:
        word = self.peek()
        if word == "(":
            self.take()
            node = self.either()
            self.take(")")
            return node
        if word == "[":
            return S.at_least_node(self.group(), 1)
        if word == "ALL" and self.peek(1) == "OF":
            self.at += 2
            items = self.group()
            return S.at_least_node(items, len(items))
        if word == "AT" and self.peek(1) == "LEAST":
            self.at += 2
            n = self.take()
            self.take("OF")
            items = self.group()
            return S.at_least_node(items, S.share(len(items), float(n[:-1])) if n.endswith("%") else int(n))
        if word == "CONTAINS":
            self.take()
            return self.contains(self.take())
        if word == "MATCHES":
            self.take()
            return S.token_node(S.regex_test(self.take()))
        self.take()
        if word.startswith('"'):
            return self.phrase(word)
        if self.peek() == "TO":
            self.take()
            ends = [None if w == "*" else w for w in (word, self.take())]
            return S.token_node(S.range_test(*ends))
        if word == "*":
            return S.all_node()
        if word in ("NOT", "AND", "OR", ")", "]"):
            raise InvalidQueryError(f"tinql can't begin with {word}")
        return self.contains(word)

    @staticmethod
    def contains(word: str) -> Node:
        if fuzzy := re.fullmatch(r"(.+?)~(?:(\d+):)?(\d+)?", word):
            return S.token_node(S.fuzzy_test(fold_text(fuzzy[1]), int(fuzzy[3] or 1), int(fuzzy[2]) if fuzzy[2] else 1))
        return S.token_node(S.wildcard_test(word)) if re.search(r"[*?]", word) else S.text_node(word)

    @staticmethod
    def phrase(word: str) -> Node:
        body, _, slop = word[1:].rpartition('"')
        slots = []
        for part in re.findall(r"\[(?:[^\]\\]|\\.)*\]|(?:\\.|[^\s\\\[])+", body):
            plain = re.sub(r"\\(.)", r"\1", part)
            if part == "_":
                slots.append(None)
            elif part.startswith("["):
                slots.append(_one_of(query_tokens(plain[1:-1])))
            else:
                slots += [S.word_test(w) for w in query_tokens(plain)]
        return S.phrase_node(slots, int(slop[1:] or 0) if slop else 0) if slots else S.none_node()


def parsed(text: str) -> Node:
    parser = _Parser(text)
    node = parser.either()
    if parser.peek():
        raise InvalidQueryError(f"tinql has {parser.peek()!r} left over")
    return node
