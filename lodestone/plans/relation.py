"""A lazy search: options that build on one another, compiled to one DataFrame when something is asked of it."""

from __future__ import annotations

import dataclasses
import functools
import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import notices
from ..errors import InvalidQueryError, UnsupportedError
from ..functions import jsonpath
from ..functions.analysis import casing, tokens
from ..operators import aggregations, boosts, highlighting, matching, paging, scoring
from ..operators import spans as S
from ..operators.filters import Filters
from ..operators.projection import SourceFilter
from ..operators.tinql import compiled
from ..sources.model import MAX_WEIGHT, TEXT_MODES, Field, SearchModel
from .index import Found, documents_of, held_small
from .results import SearchResults

DEFAULT_LIMIT = 10_000
#: Called with (event, milliseconds) after each search, count and aggregation.
listeners: list[Callable[[str, float], None]] = []
OPTIONS = {
    "term", "fields", "match", "operator", "misspellings", "where", "order", "limit", "per_page", "offset", "page", "padding", "load", "total_entries", "countless", "keyset", "after",
    "aggs", "smart_aggs", "includes", "model_includes", "scope_results", "exclude", "select", "highlight", "boost_by", "boost", "boost_where", "boost_by_recency", "conversions",
    "conversions_v1", "conversions_v2", "conversions_term", "tinql", "block",
}
MERGED = ("boost_by", "boost_where", "boost_by_recency", "aggs", "model_includes", "includes")
APPENDED = ("fields", "exclude", "select", "order")


def _list(value) -> list:
    return [] if value is None else list(value) if isinstance(value, (list, tuple)) else [value]


def _by_case(method: Callable) -> Callable:
    """Expressions that the method makes keep the case if the model's analysis does."""

    @functools.wraps(method)
    def run(self, *args):
        with casing(self.model.case_sensitive):
            return method(self, *args)

    return run


class Relation:
    """An immutable search.  Every option is a method that returns a new one: rel.where(...).order(...).limit(5)."""

    def __init__(self, model: SearchModel, options: dict):
        if unknown := set(options) - OPTIONS:
            raise InvalidQueryError(f"unknown options: {', '.join(sorted(unknown))}")
        self.model = model
        self.options = {k: v for k, v in options.items() if v is not None}
        self._loaded: SearchResults | None = None

    # options

    def _with(self, **changes) -> Relation:
        return Relation(self.model, {**self.options, **changes})

    def __getattr__(self, name: str):
        if name not in OPTIONS:
            raise AttributeError(name)

        def method(*values, **named):
            value = named if named else list(values) if len(values) > 1 else values[0] if values else True
            held = self.options.get(name)
            if name in APPENDED and held is not None:
                value = [*_list(held), *_list(value)]
            elif name in MERGED and held is not None:
                if name in ("aggs", "boost_by"):
                    held, value = ({n: {} for n in _list(x)} if not isinstance(x, dict) else x for x in (held, value))
                value = {**held, **value} if isinstance(held, dict) and isinstance(value, dict) else [*_list(held), *_list(value)]
            return self._with(**{name: value})

        return method

    def where(self, filters: dict | None = None, **named) -> Relation:
        added, held = {**(filters or {}), **named}, self.options.get("where") or {}
        merged = {"_and": [held, added]} if set(held) & set(added) else {**held, **added}
        return self._with(where=merged)

    def where_not(self, filters: dict | None = None, **named) -> Relation:
        return self.where({"_and": [{"_not": {**(filters or {}), **named}}]}) if not self.options.get("where") else self._with(where={"_and": [self.options["where"], {"_not": {**(filters or {}), **named}}]})

    def rewhere(self, filters: dict | None = None, **named) -> Relation:
        return self._with(where={**(filters or {}), **named})

    def reorder(self, *order) -> Relation:
        return self._with(order=list(order) if len(order) > 1 else order[0])

    def reselect(self, *columns) -> Relation:
        return self._with(select=list(columns) if len(columns) != 1 else columns[0])

    def merge(self, condition: Column | Relation) -> Relation:
        """The rows of another relation's base and filters, or of a condition, too."""
        column = condition if isinstance(condition, Column) else Filters(condition.model).condition(condition.options.get("where"))
        return Relation(self.model.scoped(self.model.df.where(column)), self.options)

    def only(self, *names: str) -> Relation:
        return Relation(self.model, {k: v for k, v in self.options.items() if k in names})

    def except_(self, *names: str) -> Relation:
        return Relation(self.model, {k: v for k, v in self.options.items() if k not in names})

    # compiling

    def _option(self, name: str, default=None):
        return self.options.get(name, default)

    @functools.cached_property
    def term(self) -> str:
        return str(self._option("term", "*"))

    @functools.cached_property
    def fields_(self) -> list[Field]:
        found = self.model.expand(_list(self._option("fields")), self._option("match"))
        if self._option("operator", "and") not in ("and", "or"):
            raise InvalidQueryError("operator is and or or")
        if self._option("tinql") is not None and any(f.mode in TEXT_MODES for f in found):
            raise InvalidQueryError("tinql takes no whole-field modes")
        return found

    def _text(self, field: Field) -> Column:
        head, *path = field.name.split(".")
        kind = self.model.column_type(head)
        if not path:
            if kind != "string" and field.mode not in TEXT_MODES:
                raise InvalidQueryError(f"{field.name!r} holds no text")
            return F.col(f"`{head}`").cast("string")
        leaf = F.try_variant_get(jsonpath.variant(F.col(f"`{head}`"), kind), jsonpath.path_text(path), "variant")
        return F.when(jsonpath.kind_of(leaf).isin("STRING", "NUMBER", "BOOLEAN"), F.try_variant_get(leaf, "$", "string"))

    @functools.cached_property
    def match_all(self) -> bool:
        return self.term == "*" and self._option("tinql") is None

    def _tokenised(self, df: DataFrame) -> DataFrame:
        """df with the tokens of each field that is searched by words, worked out once for matching and scoring."""
        words = [(k, f) for k, f in enumerate(self.fields_) if f.mode not in TEXT_MODES]
        return df.withColumns({f"__tokens_{k}": tokens(self._text(f)) for k, f in words}) if words and not (self.match_all and not self._option("exclude")) else df

    def _node(self, field: Field, spelling: matching.Misspellings) -> S.Node:
        parts = []
        if self.term != "*":
            parts.append(matching.word_node(field.mode, self.term, self._option("operator", "and"), spelling.reach(field)))
        if self._option("tinql") is not None:
            parts.append(compiled(self._option("tinql"))[1])
        return parts[0] if len(parts) == 1 else S.at_least_node(parts, len(parts))

    def _conditions(self, spelling: matching.Misspellings) -> list[Column]:
        out = []
        for k, field in enumerate(self.fields_):
            if field.mode in TEXT_MODES:
                out.append(matching.text_condition(field.mode, self._text(field), self.term))
            else:
                node = self._nodes(spelling)[k]
                out.append(_held(F.col(f"__tokens_{k}"), node.hit))
        return out

    def _nodes(self, spelling: matching.Misspellings) -> dict[int, S.Node]:
        held = self.__dict__.setdefault("_held_nodes", {})
        if spelling.on not in held:
            held[spelling.on] = {k: self._node(f, spelling) for k, f in enumerate(self.fields_) if f.mode not in TEXT_MODES}
        return held[spelling.on]

    def _indexed(self, spelling: matching.Misspellings) -> dict[int, Found] | None:
        """What the model's index has for each field; None where the table itself must be read."""
        index, held = self.model.index, self.__dict__.setdefault("_held_plans", {})
        if index is None or self.match_all or any(f.mode in TEXT_MODES for f in self.fields_) or not index.covers([f.name for f in self.fields_], self.model.case_sensitive):
            return None
        if spelling.on not in held:
            phrases = matching.exclusions(self._option("exclude"))
            found = {k: documents_of(index, self.fields_[k].name, node, matching.excluded_nodes(self.fields_[k], phrases)) for k, node in self._nodes(spelling).items()}
            held[spelling.on] = found if found and all(found.values()) else None
        return held[spelling.on]

    def _from_index(self, found: dict[int, Found], spelling: matching.Misspellings, scored: bool) -> tuple[DataFrame, int]:
        """((__pk, __lexical), how many at most): the documents that match by the index alone, scored if asked for.

        Tokens are matched, held against exclusions and scored before anything else is joined, and go no further.
        """
        most = sum(f.most for f in found.values())
        parts = [f.docs.select(F.col("pk").alias("__pk"), F.col("tokens").alias(f"__tokens_{k}"), F.col("dl").alias(f"__length_{k}")) for k, f in found.items()]
        joined = functools.reduce(lambda a, b: a.join(b, "__pk", "full"), parts)
        if len(parts) > 1:
            joined = joined.withColumns({f"__tokens_{k}": F.coalesce(f"__tokens_{k}", F.array().cast("array<string>")) for k in found})  # of fields without such words
        rows = self._matching(joined, spelling)
        return rows.select("__pk", self._base(indexed=True).alias("__lexical")) if scored else rows.select("__pk"), most

    def _matching(self, df: DataFrame, spelling: matching.Misspellings) -> DataFrame:
        """The rows of df, which has its tokens, that hold the term and nothing that is excluded."""
        if not self.match_all:
            conditions = self._conditions(spelling)
            df = df.where(functools.reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False))
        if phrases := matching.exclusions(self._option("exclude")):
            out = F.lit(False)
            for k, field in enumerate(self.fields_):
                held = F.col(f"__tokens_{k}") if field.mode not in TEXT_MODES else None
                out = out | matching.excluded(field, self._text(field), held, phrases)
            df = df.where(~F.coalesce(out, F.lit(False)))
        return df

    @_by_case
    def _lexical(self, df: DataFrame, spelling: matching.Misspellings, scored: bool = False) -> DataFrame:
        """The rows of df that match; with __lexical, their score, or the tokens to work it out from if scored."""
        if found := self._indexed(spelling):
            rows, most = self._from_index(found, spelling, scored)
            return df.join(held_small(rows, most), F.col(f"`{self.model.pk}`") == F.col("__pk")).drop("__pk")
        return self._matching(self._tokenised(df), spelling)

    @functools.cached_property
    def spelling(self) -> matching.Misspellings:
        """The misspellings that hold; below asks first, with a bounded count, whether exact words find enough."""
        found = matching.misspellings(self._option("misspellings", True))
        if "misspellings" in self.options and found.on and found.distance:
            for f in self.fields_:
                if f.mode in matching.UNFUZZY and found.reach(f):
                    raise UnsupportedError(f"{f.mode} takes no misspellings: use misspellings=False")
        for f in found.fields or ():
            if f not in {x.name for x in self.fields_}:
                raise InvalidQueryError(f"misspellings of {f!r}, which isn't searched")
        if found.below is None or self.match_all:
            return found
        if found.below <= 0:
            return found.exact()
        exact = self._hooked(self._lexical(self._filtered(), found.exact()))
        return found if exact.limit(found.below).count() < found.below else found.exact()

    def _filtered(self) -> DataFrame:
        return self.model.df.where(Filters(self.model).condition(self._option("where"))) if self._option("where") else self.model.df

    def _hooked(self, df: DataFrame) -> DataFrame:
        block = self._option("block")
        if not block:
            return df
        out = block(df)
        if not isinstance(out, DataFrame) or self.model.pk not in out.columns:
            raise InvalidQueryError("block returns a DataFrame that keeps the key")
        return out

    @_by_case
    def _score(self, df: DataFrame) -> DataFrame:
        if self.match_all:
            base = F.lit(1.0)
        else:
            base = F.col("__lexical") if "__lexical" in df.columns else self._base(indexed=False)
            base = base + self._conversions()
        return df.withColumn("_score", boosts.composed(self.model, base, self.options))

    def _base(self, indexed: bool) -> Column:
        """The lexical score, from columns of tokens."""
        base, stats, mixed = F.lit(0.0), self._word_statistics(), self._elision_off()
        for k, field in enumerate(self.fields_):
            if field.mode in TEXT_MODES:
                base = base + F.when(matching.text_condition(field.mode, self._text(field), self.term), F.lit(field.boost)).otherwise(0.0)
                continue
            length = F.col(f"__length_{k}") if indexed else None
            base = base + _weighed(F.col(f"__tokens_{k}"), length, self._nodes(self.spelling)[k], self._scored_words(k), stats[k], field.boost, not mixed, len(self.fields_) > 1)
        return base

    def _elision_off(self) -> bool:
        return any(f.mode in TEXT_MODES or f.boost > MAX_WEIGHT for f in self.fields_)

    def _scored_words(self, k: int) -> list[S.Node]:
        words = self._nodes(self.spelling)[k].words()
        return words if self.fields_[k].weight is None else [dataclasses.replace(w, leaves=[], boosted=True) for w in words]

    @_by_case
    def _word_statistics(self) -> dict[int, scoring.Statistics]:
        """Counts over the whole index, whatever the filters: looked up in it, or in one pass over the table."""
        nodes = self._nodes(self.spelling)
        every = [(k, w) for k, node in nodes.items() for w in node.words()]
        if found := self._indexed(self.spelling):
            index = self.model.index
            held = [index.holding(self.fields_[k].name, w, found[k].passed) for k, w in every]
            asked = [x.select(F.lit(i).alias("i"), "n") for i, x in enumerate(held) if isinstance(x, DataFrame)]
            counts = dict(enumerate(held)) | ({r.i: r.n for r in functools.reduce(DataFrame.union, asked).collect()} if asked else {})
            corpus = {k: index.counts[self.fields_[k].name] for k in nodes}
        else:
            held = self._tokenised(self.model.df)
            hits = [F.sum(_held(F.col(f"__tokens_{k}"), w.hit).cast("long")).alias(f"w{i}") for i, (k, w) in enumerate(every)]
            row = held.agg(F.count("*").alias("n"), *(F.avg(F.size(f"__tokens_{k}")).alias(f"m{k}") for k in nodes), *hits).first()
            counts = {i: row[f"w{i}"] or 0 for i in range(len(every))}
            corpus = {k: (row.n, row[f"m{k}"] or 1.0) for k in nodes}
        return {k: scoring.Statistics(*corpus[k], tuple(counts[i] for i, (of, _) in enumerate(every) if of == k)) for k in nodes}

    def score_inspect(self) -> DataFrame:
        """(field, word, documents, of, idf, factor, elided): what each scored word of the search weighs."""
        rows, stats = [], {} if self.match_all else self._word_statistics()
        for k, found in stats.items():
            for n, (word, holding) in enumerate(zip(self._scored_words(k), found.frequencies, strict=True)):
                out = not self._elision_off() and scoring.elided(word, holding, found.documents)
                rows.append((self.fields_[k].name, n, int(holding), int(found.documents), scoring.idf(found.documents, holding), float(word.factor * self.fields_[k].boost), out))
        return self.model.df.sparkSession.createDataFrame(rows, "field string, word int, documents long, of long, idf double, factor double, elided boolean")

    def max_score(self) -> DataFrame:
        """(max_score): the highest score of all matches."""
        return self.matched.agg(F.max("_score").alias("max_score"))

    def _conversions(self) -> Column:
        term = str(self._option("conversions_term", self.term))
        total = F.lit(0.0)
        for name, legacy, declared in (("conversions_v1", True, self.model.conversions_v1), ("conversions_v2", False, self.model.conversions_v2)):
            said = self._option(name, self._option("conversions") if legacy else None)
            if said is False:
                continue
            if said is None or said is True:
                columns, factor = declared, 1.0
            elif isinstance(said, dict):
                columns, factor, term = _list(said.get("field")) or declared, float(said.get("factor", 1)), str(said.get("term", term))
            else:
                columns, factor = _list(said), 1.0
            if factor:
                total = total + boosts.by_conversions(self.model, columns, term, legacy, factor)
        return total

    def _clean(self, df: DataFrame) -> DataFrame:
        return df.drop(*(c for c in df.columns if c.startswith(("__tokens_", "__length_")) or c == "__lexical"))

    @functools.cached_property
    def matched(self) -> DataFrame:
        """All matching rows, with _score, whatever the page."""
        return self._clean(self._hooked(self._score(self._lexical(self._filtered(), self.spelling, True))))

    @functools.cached_property
    def rows(self) -> DataFrame:
        """All matching rows without scores: nothing is counted over the index for them.  A block sees scores all the same."""
        return self.matched if self._option("block") else self._clean(self._lexical(self._filtered(), self.spelling))

    @property
    def size(self) -> int:
        n = self.options.get("limit", self.options.get("per_page", DEFAULT_LIMIT))
        if isinstance(n, bool) or not isinstance(n, int) or n < 0:
            raise InvalidQueryError("limits are integers from 0")
        return n

    @property
    def start(self) -> int:
        page, padding = self.options.get("page", 1), self.options.get("padding", 0)
        if page < 1 or padding < 0 or self.options.get("offset", 0) < 0:
            raise InvalidQueryError("pages start at 1, offsets and paddings at 0")
        return self.options.get("offset", (page - 1) * self.size + padding)

    @property
    def probing(self) -> bool:
        return bool(self._option("countless") or self._option("keyset"))

    @functools.cached_property
    def keyset_keys(self) -> list[tuple[str, bool]]:
        if self._option("after") is not None and not self._option("keyset"):
            raise InvalidQueryError("after needs keyset")
        if not self._option("keyset"):
            return []
        if self.options.get("offset") or self.options.get("page", 1) > 1 or self.options.get("padding") or self.size == 0:
            raise InvalidQueryError("a keyset takes no offset, page or padding and a limit above 0")
        return paging.keyset_keys(self._option("order"), self.model)

    def page_frame(self) -> DataFrame:
        """The page, ordered: a bounded sort, with one row more where the next page is probed for."""
        df = self.matched
        keys = self.keyset_keys
        if keys and self._option("after") is not None:
            df = df.where(paging.after_condition(keys, paging.decode(self.model, keys, self._option("after"))))
        df = df.orderBy(*paging.sort_columns(keys or paging.order_keys(self._option("order"), self.model.pk), self.model))
        if self.start and not keys:
            df = df.offset(self.start)
        return df.limit(self.size + 1 if self.probing else self.size)

    def hit_frame(self) -> DataFrame:
        """(_id, _index, _score, _source, highlight): all matches as hits in their order, whatever the page, without a driver's loop.

        What results().hits has for a page; highlight is a map from fields to their fragments, without fields that nothing matches in.
        """
        if named := [n for n in ("scope_results", "includes", "model_includes") if self._option(n)]:
            raise UnsupportedError(f"{', '.join(named)}: only pages have them")
        if any("." in str(p) for p in _patterns(self._option("select"))):
            raise UnsupportedError("parts of nested values are selected on pages only")
        shown = SourceFilter(self._option("select")).columns(list(self.model.df.columns))
        keys = self.keyset_keys or paging.order_keys(self._option("order"), self.model.pk)
        df = self.highlighted(self.matched.orderBy(*paging.sort_columns(keys, self.model)))
        marks = F.lit(None).cast("map<string,array<string>>")
        whole, cuts = self._marks(df)
        df = df.withColumns({f"__cut_{name}": F.array(F.col(c)) for name, c in whole.items()})
        if cuts:
            df = highlighting.with_fragments(df, {f"__cut_{name}": how for name, how in cuts.items()})
        if each := [F.struct(F.lit(name).alias("key"), F.col(f"`__cut_{name}`").alias("value")) for name in [*whole, *cuts]]:
            marks = F.map_from_entries(F.filter(F.array(*each), lambda m: m["value"][0].isNotNull()))
        source = F.struct(*(F.col(f"`{c}`") for c in shown))
        return df.select(F.col(f"`{self.model.pk}`").cast("string").alias("_id"), F.lit(self.model.name).alias("_index"), "_score", source.alias("_source"), marks.alias("highlight"))

    def _marks(self, df: DataFrame) -> tuple[dict[str, str], dict[str, tuple]]:
        """Of the searched fields that df has highlights of: those shown whole with their columns, and those cut to fragments
        with (column of parts, tag, size, number, html)."""
        (settings, own), whole, cuts = self._highlights(), {}, {}
        for name in dict.fromkeys(f.name for f in self.fields_):
            column = name.replace(".", "_")
            if f"highlighted_{column}" in df.columns:
                each = {**(settings or {}), **((own or {}).get(name) or {})}
                size, number = each.get("fragment_size"), each.get("number_of_fragments", highlighting.FRAGMENTS)
                if size and number:
                    cuts[name] = (f"__marks_{column}", each.get("tag", highlighting.TAG), size, number, each.get("encoder") == "html")
                else:
                    whole[name] = f"highlighted_{column}"
        return whole, cuts

    def walk(self) -> DataFrame:
        """(__page, __place, columns): all pages of a keyset at once, from its cursor on; pages and places count from 0.

        Walking them by their cursors reads the table once a page.  Here it is sorted once, by ranges, and the ranges' sizes
        give the places.
        """
        if not self.keyset_keys:
            raise InvalidQueryError("walk needs keyset")
        keys, df = self.keyset_keys, self.matched
        if self._option("after") is not None:
            df = df.where(paging.after_condition(keys, paging.decode(self.model, keys, self._option("after"))))
        return paging.placed(df, paging.sort_columns(keys, self.model)).withColumn("__page", F.expr(f"`__place` div {self.size}"))

    def _highlights(self) -> tuple[dict | None, dict | None]:
        """(settings of all fields, those of single fields or None for all that are searched); no settings: no highlights."""
        said = self._option("highlight")
        if said is None or said is False:
            return None, None
        if said is not True and not isinstance(said, dict):
            raise InvalidQueryError("highlight takes true, false or options")
        settings = dict(said) if isinstance(said, dict) else {}
        chosen = settings.pop("fields", None)
        own = chosen if isinstance(chosen, dict) else {n: {} for n in chosen} if chosen is not None else None
        for name, options in {"": settings, **(own or {})}.items():
            if unknown := set(options or {}) - {"tag", "encoder", "fragment_size", "number_of_fragments"}:
                raise InvalidQueryError(f"unknown highlight options: {', '.join(sorted(unknown))}")
            if name:
                self.model.column_type(name.split(".")[0])
        return settings, own

    @_by_case
    def highlighted(self, df: DataFrame) -> DataFrame:
        """df with highlighted_<field> for each field that the highlight option names and the search looked in.

        A field searched in several modes is marked whole where a whole-field mode matches, else by all its words.
        """
        settings, own = self._highlights()
        if settings is None or self.match_all:
            return df
        out, dropped = {}, []
        for name in dict.fromkeys(f.name for f in self.fields_):
            if own is not None and name not in own:
                continue
            each = {**settings, **((own or {}).get(name) or {})}
            modes = [(k, f) for k, f in enumerate(self.fields_) if f.name == name]
            text = self._text(modes[0][1])
            wholes = [highlighting.whole(text, matching.text_condition(f.mode, text, self.term)) for _, f in modes if f.mode in TEXT_MODES]
            nodes = [self._nodes(self.spelling)[k] for k, f in modes if f.mode not in TEXT_MODES]
            found = [*wholes, *([highlighting.parts(text, S.at_least_node(nodes, 1))] if nodes else [])]
            column = name.replace(".", "_")
            df = df.withColumn(f"__marks_{column}", F.coalesce(*found))
            out["highlighted_" + column] = highlighting.drawn(F.col(f"__marks_{column}"), each.get("tag", highlighting.TAG), each.get("encoder") == "html")
            if not each.get("fragment_size"):
                dropped.append(f"__marks_{column}")
        if out:
            df = df.withColumns(out).drop(*dropped)
        return self._clean(df)

    # asking

    def _timed(self, event: str, ask: Callable):
        began = time.perf_counter()
        try:
            return ask()
        finally:
            for tell in listeners:
                tell(event, (time.perf_counter() - began) * 1000)

    def to_df(self) -> DataFrame:
        """The page as a DataFrame with _score."""
        return self.page_frame()

    def load(self, value: bool | None = None):
        """The page; load(False), as load=False, gives its rows as hits with their scores (see SearchResults)."""
        return self.results() if value is None else self._with(load=value)

    def results(self) -> SearchResults:
        if self._loaded is None:
            self._loaded = self._timed("search", lambda: SearchResults(self))
        return self._loaded

    def count(self) -> int:
        """All matching rows, whatever the page."""
        return self._timed("count", lambda: self.rows.count())

    def agg_frames(self) -> dict[str, tuple[str, DataFrame, DataFrame | None]]:
        """(kind, facet, doc_count) of each aggregation.

        A facet sees all matches.  Smart facets see the filters on other fields too; one with a where of its own sees
        all filters and its own; without smart_aggs only its own.
        """
        base = self._clean(self._hooked(self._lexical(self.model.df, self.spelling)))
        where, out = self._option("where") or {}, {}
        for name, options in aggregations.normalised(self._option("aggs")).items():
            own = options.get("where")
            field = options.get("field", name)
            others = {k: v for k, v in where.items() if k != field}
            if not self._option("smart_aggs", True) or not others:
                used = own
            else:
                used = others if own is None else {"_and": [where, own]} if set(where) & set(own) else {**where, **own}
            df = base.where(Filters(self.model).condition(used)) if used else base
            kind, facet = aggregations.aggregate(df, self.model, name, options, self.model.df)
            counted = df.agg(F.count_distinct(self.model.pk).alias("doc_count")) if own is not None else None
            out[name] = (kind, facet, counted)
        return out

    def aggs_results(self) -> dict[str, dict]:
        def ask():
            out = {}
            for name, (kind, facet, counted) in self.agg_frames().items():
                options = aggregations.normalised(self._option("aggs"))[name]
                inner = options.get(kind) if isinstance(options.get(kind), dict) else {}
                out[name] = aggregations.buckets(kind, facet, {**options, **inner})
                if counted is not None:
                    out[name]["doc_count"] = counted.first()[0]
            return out

        return self._timed("aggregations", ask)

    def pluck(self, *columns: str) -> list:
        rows = self.page_frame().limit(self.size).select(*columns).collect()
        return [r[0] for r in rows] if len(columns) == 1 else [tuple(r) for r in rows]

    def first(self, n: int | None = None):
        rows = self._with(limit=min(self.size, n or 1)).results()
        return list(rows) if n is not None else next(iter(rows), None)

    def __iter__(self) -> Iterator:
        return iter(self.results())

    def __len__(self) -> int:
        return len(self.results())

    def __getitem__(self, at):
        return self.results()[at]


def _patterns(select) -> list:
    return [p for v in select.values() for p in _list(v)] if isinstance(select, dict) else _list(select)


def _held(tokens_: Column, test: Callable[[Column], Column]) -> Column:
    """test of the tokens, worked out once: filters move below projections and take the tokens' expression with them."""
    return S.let(tokens_, test)


def _weighed(tokens_: Column, length: Column | None, node: S.Node, words: list[S.Node], stats: scoring.Statistics, boost: float, elide: bool, guarded: bool) -> Column:
    def lexical(t: Column) -> Column:
        found = scoring.bm25(words, t, F.size(t) if length is None else F.coalesce(length, F.lit(0)), stats, elide) * boost
        return F.when(node.hit(t), found).otherwise(0.0) if guarded else found

    return _held(tokens_, lexical)
