"""A loaded page: rows, hits, page numbers, cursor, highlights and aggregations."""

from __future__ import annotations

import functools
import math
import time
from collections.abc import Iterator

from pyspark.sql import functions as F

from .. import notices
from ..operators import highlighting, paging
from ..operators.projection import SourceFilter


class SearchResults:
    """The rows of a relation's page as dictionaries.  Only the page, at most its limit and one probing row, is collected."""

    def __init__(self, relation):
        began = time.perf_counter()
        self.relation, self.model = relation, relation.model
        if relation.options.get("load") is False:
            notices.warn(self.model.name, "load=False gives the same rows")
        shown = SourceFilter(relation.options.get("select"))
        keys = [n for n, _ in relation.keyset_keys]
        frame = relation.highlighted(relation.page_frame())
        wanted = shown.columns([c for c in self.model.df.columns])
        hidden = [c for c in dict.fromkeys([self.model.pk, *keys]) if c not in wanted]
        marks = [c for c in frame.columns if c.startswith(("highlighted_", "__marks_"))]
        rows = [r.asDict(recursive=True) for r in frame.select(*(f"`{c}`" for c in dict.fromkeys([*wanted, *hidden])), "_score", *marks).collect()]
        self.more = relation.probing and len(rows) > relation.size
        rows = rows[: relation.size]
        self.cursor = paging.encode(self.model, relation.keyset_keys, rows[-1]) if self.more and relation.keyset_keys else None
        self.missing_records: list = []
        if scope := relation.options.get("scope_results"):
            rows = self._scoped(rows, scope)
        self._raw = rows
        loaded = self._preloaded([r[self.model.pk] for r in rows])
        self.rows = [shown({k: v for k, v in r.items() if k in wanted}) for r in rows]
        for r, raw in zip(self.rows, rows, strict=True):
            r.update({name: found.get(raw[self.model.pk], []) for name, found in loaded.items()})
        self.took = (time.perf_counter() - began) * 1000
        self.error = None

    def _scoped(self, rows: list[dict], scope) -> list[dict]:
        """The rows of the page that a scope keeps, in the page's order; the others' ids are missing."""
        pk = self.model.pk
        ids = [r[pk] for r in rows]
        kept = {r[0] for r in scope(self._of_page(self.model.df, pk, ids)).select(pk).collect()} if ids else set()
        self.missing_records = [{"id": i, "model": self.model.name} for i in ids if i not in kept]
        return [r for r in rows if r[pk] in kept]

    def _of_page(self, df, column: str, ids: list):
        """The rows of df whose column holds one of the page's ids: joined with them, at most a page's limit."""
        page = df.sparkSession.createDataFrame([(i,) for i in ids], f"__id {self.model.column_type(self.model.pk)}")
        return df.join(F.broadcast(page), F.col(column) == F.col("__id"), "left_semi")

    def _preloaded(self, ids: list) -> dict[str, dict]:
        """includes and model_includes, {name: (DataFrame, foreign key)}: the page's child rows by their parent, one lookup each."""
        wanted = {**(self.relation.options.get("includes") or {}), **(self.relation.options.get("model_includes") or {})}
        out: dict[str, dict] = {}
        for name, (children, foreign) in wanted.items():
            found: dict = {}
            for r in self._of_page(children, foreign, ids).collect() if ids else []:
                found.setdefault(r[foreign], []).append(r.asDict(recursive=True))
            out[name] = found
        return out

    def __iter__(self) -> Iterator[dict]:
        return iter(self.rows)

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, at):
        return self.rows[at]

    @functools.cached_property
    def total_count(self) -> int:
        return self.relation.options.get("total_entries", None) if self.relation.options.get("total_entries") is not None else self.relation.count()

    total_entries = property(lambda self: self.total_count)
    size = property(lambda self: len(self.rows))
    per_page = property(lambda self: self.relation.size)
    limit_value = per_page
    current_page = property(lambda self: self.relation.options.get("page", 1))
    padding = property(lambda self: self.relation.options.get("padding", 0))
    offset = property(lambda self: self.relation.start)
    offset_value = offset

    @property
    def total_pages(self) -> int:
        return math.ceil(self.total_count / self.per_page) if self.per_page else 0

    num_pages = total_pages

    @property
    def has_next_page(self) -> bool:
        return self.more if self.relation.probing else self.current_page < self.total_pages

    next_page = property(lambda self: self.current_page + 1 if self.has_next_page else None)
    previous_page = property(lambda self: self.current_page - 1 if self.current_page > 1 else None)
    first_page = property(lambda self: self.previous_page is None)
    last_page = property(lambda self: self.next_page is None)
    out_of_range = property(lambda self: self.current_page > self.total_pages)
    next_cursor = property(lambda self: self.cursor)
    misspellings = property(lambda self: self.relation.spelling.on)
    model_name = property(lambda self: self.model.name)
    entry_name = property(lambda self: self.model.name.replace("_", " "))

    @functools.cached_property
    def highlights(self) -> list[dict]:
        """For each row its highlighted fields, cut to fragments as asked."""
        options, own = self.relation._highlights()
        options, own = options or {}, own or {}
        out = []
        for r in self._raw:
            found = {}
            for field in self.relation.fields_:
                name = field.name.replace(".", "_")
                text = r.get("highlighted_" + name)
                if text is None:
                    continue
                each = {**options, **(own.get(field.name) or {})}
                tag, size, number = each.get("tag", highlighting.TAG), each.get("fragment_size"), each.get("number_of_fragments", highlighting.FRAGMENTS)
                found[field.name] = highlighting.fragments(r["__marks_" + name], tag, size, number, each.get("encoder") == "html") if size and number else [text]
            out.append(found)
        return out

    def with_highlights(self, multiple: bool = False) -> list[tuple[dict, dict]]:
        return [(r, h if multiple else {k: v[0] for k, v in h.items() if v}) for r, h in zip(self.rows, self.highlights, strict=True)]

    def with_score(self) -> list[tuple[dict, float]]:
        return [(r, raw["_score"]) for r, raw in zip(self.rows, self._raw, strict=True)]

    @functools.cached_property
    def hits(self) -> list[dict]:
        out = []
        for r, raw, marks in zip(self.rows, self._raw, self.highlights, strict=True):
            hit = {"_id": str(raw[self.model.pk]), "_index": self.model.name, "_score": raw["_score"], "_source": r}
            out.append(hit | ({"highlight": marks} if marks else {}))
        return out

    def with_hit(self) -> list[tuple[dict, dict]]:
        return list(zip(self.rows, self.hits, strict=True))

    @functools.cached_property
    def aggs(self) -> dict[str, dict]:
        return self.relation.aggs_results()

    @property
    def aggregations(self) -> dict[str, dict]:
        """aggs, with those that have a where of their own in an envelope: {doc_count, name: facet}."""
        return {name: {"doc_count": found["doc_count"], name: {k: v for k, v in found.items() if k != "doc_count"}} if "doc_count" in found else found for name, found in self.aggs.items()}

    @property
    def max_score(self) -> float | None:
        """The highest score of the page, which is that of all matches where the page is ordered by score from the start."""
        return max((raw["_score"] for raw in self._raw if raw["_score"] is not None), default=None)

    @property
    def response(self) -> dict:
        known = not self.relation.probing or self.relation.options.get("total_entries") is not None
        hits = {"hits": self.hits} | ({"total": {"value": self.total_count, "relation": "eq"}} if known else {})
        out = {"took": round(self.took), "timed_out": False, "hits": hits}
        return out | ({"aggregations": self.aggregations} if self.relation.options.get("aggs") else {})
