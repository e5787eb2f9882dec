"""Searchable tables: a DataFrame, its key and its search options."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from ..errors import InvalidQueryError, MissingFieldError, UnsupportedError

MODES = ("word", "phrase", "word_start", "word_middle", "word_end", "exact", "text_start", "text_middle", "text_end")
TEXT_MODES = ("exact", "text_start", "text_middle", "text_end")
MAX_WEIGHT = 10_000.0
models: dict[str, SearchModel] = {}


@dataclass(frozen=True)
class Field:
    """A searched field: a column or a dotted path into a JSON column, its match mode and weight."""

    name: str
    mode: str
    weight: float | None = None

    @property
    def boost(self) -> float:
        return 1.0 if self.weight is None else self.weight


@dataclass(frozen=True)
class SearchModel:
    """A table that can be searched.

    df is the base scope: what it doesn't hold is never seen.  pk is its single key.  enums maps a column to its labels
    and stored numbers, json names text columns that hold JSON.  fields_hook may name the searchable fields instead.
    index is a TextIndex of the fields, used where it can answer; with case_sensitive, words keep their case.
    """

    df: DataFrame
    pk: str = "id"
    name: str = "model"
    searchable: tuple[str, ...] | None = None
    default_fields: tuple[str, ...] | None = None
    match: str = "word"
    case_sensitive: bool = False
    enums: dict[str, dict[str, int]] = field(default_factory=dict)
    json: tuple[str, ...] = ()
    conversions_v1: tuple[str, ...] = ()
    conversions_v2: tuple[str, ...] = ()
    fields_hook: Callable[[], list[str]] | None = None
    index: object | None = None
    stem: bool = False
    stem_conversions: bool = False

    def __post_init__(self):
        if self.stem or self.stem_conversions:
            raise UnsupportedError("stemming isn't offered")
        if isinstance(self.pk, (list, tuple)):
            raise InvalidQueryError("a model needs a single key")
        if self.match not in MODES:
            raise InvalidQueryError(f"unknown match mode {self.match!r}")
        self.column_type(self.pk)
        for name in self.searchable or ():
            self.column_type(name.split(".")[0])

    def register(self) -> SearchModel:
        if self.name in models:
            raise InvalidQueryError(f"model {self.name!r} is declared already")
        models[self.name] = self
        return self

    def scoped(self, df: DataFrame) -> SearchModel:
        """The same model over a narrower base scope; text statistics stay those of the whole index if there is one."""
        return replace(self, df=df)

    def column_type(self, name: str) -> str:
        for f in self.df.schema:
            if f.name == name:
                return f.dataType.simpleString()
        raise MissingFieldError(f"unknown field {name!r}")

    def with_index(self, key: str | None = None) -> SearchModel:
        """The same model with an index of its text fields, built once in a session for each key (its name, else)."""
        from ..plans.index import session_index

        return replace(self, index=session_index(self, key or self.name))

    def text_fields(self) -> list[str]:
        if self.fields_hook:
            names = list(self.fields_hook())
            for n in names:
                self.column_type(n.split(".")[0])
            return names
        return list(self.searchable or [f.name for f in self.df.schema if f.dataType.simpleString() == "string" and f.name not in self.json])

    def expand(self, fields, match: str | None) -> list[Field]:
        """Selectors as fields: names, name^weight, {name: mode}, * and *.path patterns.  The last weight of one wins."""
        default = match or self.match
        if default not in MODES:
            raise InvalidQueryError(f"unknown match mode {default!r}")
        known = self.text_fields()
        found: dict[tuple[str, str], float | None] = {}
        for selector in fields if fields else (self.default_fields or known):
            pairs = selector.items() if isinstance(selector, dict) else [(selector, default)]
            for text, mode in pairs:
                if mode not in MODES:
                    raise InvalidQueryError(f"unknown match mode {mode!r}")
                name, _, weight = str(text).partition("^")
                if weight and not re.fullmatch(r"\d+(\.\d+)?", weight):
                    raise InvalidQueryError(f"weight of {text!r} isn't a number from 0")
                if "*" in name:
                    names = [n for n in known if fnmatch.fnmatchcase(n, name)]
                else:
                    self.column_type(name.split(".")[0])
                    names = [name]
                for n in names:
                    if weight or (n, mode) not in found:
                        found[n, mode] = float(weight) if weight else None
        return [Field(n, m, w) for (n, m), w in found.items()]

    def search(self, term: str = "*", **options):
        from ..plans.relation import Relation

        return Relation(self, {"term": term, **options})


def search(term: str = "*", *, model: SearchModel | str, **options):
    return (models[model] if isinstance(model, str) else model).search(term, **options)


def parquet_model(spark: SparkSession, path: str, **options) -> SearchModel:
    """A model over Parquet files; filters and columns reach the scan."""
    return SearchModel(spark.read.parquet(path), **options)
