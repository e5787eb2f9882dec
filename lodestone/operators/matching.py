"""Ordinary search text: match modes, misspellings and excluded phrases."""

from __future__ import annotations

import functools
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidQueryError, UnsupportedError
from ..functions.analysis import casing, fold, fold_text, query_tokens
from ..sources.model import TEXT_MODES, Field
from . import spans as S
from .spans import Node


#: Modes that can't be combined with misspellings that a search asks for.
UNFUZZY = ("word_start", "word_middle", "word_end", "text_start", "text_middle", "text_end")


@dataclass(frozen=True)
class Misspellings:
    """Edits allowed in words: how many, after how many fixed letters, in which fields, and when."""

    distance: int = 1
    prefix: int = 1
    below: int | None = None
    fields: tuple[str, ...] | None = None
    on: bool = True

    def exact(self) -> Misspellings:
        return replace(self, on=False)

    def reach(self, field: Field) -> tuple[int, int] | None:
        return (self.distance, self.prefix) if self.on and (self.fields is None or field.name in self.fields) else None


def misspellings(option) -> Misspellings:
    if option is True or option is None:
        return Misspellings()
    if option is False:
        return Misspellings(on=False)
    if not isinstance(option, dict):
        raise InvalidQueryError("misspellings takes true, false or options")
    if option.get("transpositions"):
        raise UnsupportedError("transpositions count as two edits")
    if "max_expansions" in option:
        raise UnsupportedError("max_expansions isn't offered")
    if unknown := set(option) - {"edit_distance", "distance", "prefix_length", "below", "fields", "transpositions"}:
        raise InvalidQueryError(f"unknown misspellings options: {', '.join(sorted(unknown))}")
    distance, prefix = option.get("edit_distance", option.get("distance", 1)), option.get("prefix_length", 1)
    for n in (distance, prefix):
        if isinstance(n, bool) or not isinstance(n, int) or n < 0:
            raise InvalidQueryError("distances and prefixes are integers from 0")
    fields = option.get("fields")
    return Misspellings(distance, prefix, option.get("below"), tuple(fields) if fields else None)


def word_node(mode: str, term: str, together: str, reach: tuple[int, int] | None) -> Node:
    """The words of a term in a field: all or any of them, by mode.  No words match nothing."""
    words = query_tokens(term)
    if not words:
        return S.none_node()
    if mode == "phrase":
        return S.phrase_node([S.word_test(w) for w in words])

    def one(w: str) -> Node:
        if mode == "word_start":
            return S.token_node(lambda x: x.startswith(w))
        if mode == "word_middle":
            return S.token_node(lambda x: x.contains(w))
        if mode == "word_end":
            return S.token_node(lambda x: x.endswith(w))
        return S.token_node(S.fuzzy_test(w, *reach)) if reach and reach[0] else S.plain_node(w)

    items = [one(w) for w in dict.fromkeys(words)]
    return S.at_least_node(items, len(items) if together == "and" else 1)


def text_condition(mode: str, column: Column, term: str) -> Column:
    """Whole-field modes: byte by byte for exact, folded for the others."""
    if mode == "exact":
        return F.coalesce(column == F.lit(term), F.lit(False))
    with casing(False):
        wanted, folded = fold_text(term), fold(column)
    if not wanted.strip():
        return F.lit(False)
    found = {"text_start": folded.startswith(wanted), "text_middle": folded.contains(wanted), "text_end": folded.endswith(wanted)}[mode]
    return F.coalesce(found, F.lit(False))


def exclusions(option) -> list[str]:
    if option is None or option is False:
        return []
    return [str(x).lower() if isinstance(x, bool) else str(x) for x in (option if isinstance(option, (list, tuple)) else [option])]


def excluded_nodes(field: Field, phrases: list[str]) -> list[Node]:
    """What a field that is searched by words must not hold, read by its mode."""
    return [word_node("phrase" if field.mode == "word" else field.mode, phrase, "and", None) for phrase in phrases]


def excluded(field: Field, column: Column, tokens: Column | None, phrases: list[str], nodes: list[Node] | None = None) -> Column:
    """Whether a field holds an excluded phrase; nodes are its excluded_nodes() if they are made already."""
    if field.mode in TEXT_MODES:
        each = [text_condition(field.mode, column, phrase) for phrase in phrases]
    else:
        each = [S.let(tokens, node.hit) for node in nodes or excluded_nodes(field, phrases)]
    return functools.reduce(lambda a, b: a | b, each, F.lit(False))
