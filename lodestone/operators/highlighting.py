"""Highlights: matched words of a text between tags, whole or in fragments.

Words are found by their place among the tokens, never by offsets in folded text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions.analysis import TOKEN_RE, fold
from .spans import Node, let

TAG = "<em>"
#: Fragments of a field at most, where the search doesn't say.
FRAGMENTS = 5
#: Characters the html encoder replaces (fixed values).
ENTITIES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#39;", "/": "&#x2F;"}


def closing(tag: str) -> str:
    found = re.match(r"<\s*([A-Za-z][\w-]*)", tag)
    return f"</{found[1]}>" if found else tag


def encoded(text: Column) -> Column:
    for c, entity in ENTITIES.items():
        text = F.replace(text, F.lit(c), F.lit(entity))
    return text


def parts(text: Column, node: Node) -> Column:
    """The text's words and what stands between them, in order, as (text, open, close, hit): whether a mark begins or ends
    there, and whether it holds this part.  Overlapping spans are one mark.  Null where nothing matches."""
    pieces = F.regexp_extract_all(text, F.lit(TOKEN_RE), F.lit(0))
    gaps = F.split(text, TOKEN_RE, -1)

    def part(x: Column, begins: Column, ends: Column, hit: Column) -> Column:
        return F.struct(x.alias("text"), begins.alias("open"), ends.alias("close"), hit.alias("hit"))

    def built(words: Column) -> Column:
        folded = F.transform(words, lambda w: F.regexp_replace(fold(w), "[️⃣]", ""))
        return let(let(folded, node.spans), lambda spans: let(gaps, lambda between: drawn(words, between, spans)))

    def drawn(words: Column, between: Column, spans: Column) -> Column:
        no = F.lit(False)

        def one(w: Column, i: Column) -> Column:
            at = i + 1
            onward = F.exists(spans, lambda s: (s["s"] <= at) & (at < s["e"]))
            begins = F.exists(spans, lambda s: s["s"] == at) & ~F.exists(spans, lambda s: (s["s"] < at) & (at <= s["e"]))
            ends = F.exists(spans, lambda s: s["e"] == at) & ~onward
            held = F.exists(spans, lambda s: (s["s"] <= at) & (at <= s["e"]))
            return F.array(part(w, begins, ends, held), part(F.get(between, i + 1), no, no, onward))

        whole = F.concat(F.array(part(F.get(between, F.lit(0)), no, no, no)), F.flatten(F.transform(words, one)))
        return F.when(F.size(spans) > 0, whole)

    return let(pieces, built)


def drawn(found: Column, tag: str = TAG, html: bool = False) -> Column:
    """parts() as one text with its marks."""
    tail, clean = closing(tag), (encoded if html else (lambda x: x))
    return F.array_join(F.transform(found, lambda p: F.concat(F.when(p["open"], tag).otherwise(""), clean(p["text"]), F.when(p["close"], tail).otherwise(""))), "")


def whole(text: Column, condition: Column) -> Column:
    """The whole field as one marked part where a whole-field mode matches."""
    yes = F.lit(True)
    return F.when(condition, F.array(F.struct(text.alias("text"), yes.alias("open"), yes.alias("close"), yes.alias("hit"))))


def fragments(found: list[dict], tag: str, size: int, number: int, html: bool = False) -> list[str]:
    """Cuts of the parts of a page's text around its marks: whole marks, whole graphemes, at most so many."""
    units: list[tuple[str, bool]] = []
    for p in found:
        if p["hit"] and not p["open"]:
            units[-1] = (units[-1][0] + p["text"], True)
        elif p["hit"]:
            units.append((p["text"], True))
        else:
            units += [(g, False) for g in regex.findall(r"\X", p["text"])]
    length = [len(regex.findall(r"\X", u)) if hit else 1 for u, hit in units]
    clean = (lambda u: "".join(ENTITIES.get(c, c) for c in u)) if html else (lambda u: u)
    out, covered = [], -1
    for k, (_, hit) in enumerate(units):
        if not hit or k <= covered or len(out) == number:
            continue
        low = high = k
        room = size - length[k]
        while room > 0 and (low > covered + 1 or high + 1 < len(units)):
            before = room
            if low > covered + 1 and length[low - 1] <= room:
                low -= 1
                room -= length[low]
            if high + 1 < len(units) and length[high + 1] <= room:
                high += 1
                room -= length[high]
            if room == before:
                break
        covered = high
        out.append("".join(f"{tag}{clean(u)}{closing(tag)}" if h else clean(u) for u, h in units[low : high + 1]))
    return out


def with_fragments(df: DataFrame, cuts: dict[str, tuple[str, str, int, int, bool]]) -> DataFrame:
    """df with a column of fragments() for each (column of parts, tag, size, number, html), cut where the rows are."""
    # an Arrow map, as Spark evaluates no Python function of an expression that holds lambdas
    schema = df.schema
    for name in cuts:
        schema = StructType(schema.fields + [StructField(name, ArrayType(StringType()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [[None if found is None else fragments(found, *how) for found in batch.column(parts).to_pylist()] for parts, *how in cuts.values()]
            columns = [*batch.columns, *(pa.array(m, pa.list_(pa.string())) for m in made)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *cuts])

    return df.mapInArrow(cut, schema)


def ansi(text: Column, node: Node, wrap: str = "\x1b[1m") -> Column:
    """The text with its matched spans between a terminal's escape sequence and its reset."""
    return F.array_join(F.transform(parts(text, node), lambda p: F.concat(F.when(p["open"], wrap).otherwise(""), p["text"], F.when(p["close"], "\x1b[0m").otherwise(""))), "")
