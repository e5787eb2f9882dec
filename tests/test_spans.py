"""Span expressions against a plain evaluator over lists of words."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone import InvalidQueryError
from lodestone.operators.tinql import compiled, parsed

WORDS = ["ash", "birch", "elm", "fir", "oak", "yew"]


def spans(expression, words):
    """The (first, last) of each match, counted from 1; a document matches with at least one."""
    n = len(words)
    if isinstance(expression, str):
        slots = expression.split()
        return {(i + 1, i + len(slots)) for i in range(n - len(slots) + 1) if words[i : i + len(slots)] == slots}
    (name, value), rest = next(iter(expression.items())), expression
    each = [spans(v, words) for v in value] if isinstance(value, list) and name != "phrase" else []
    if name == "phrase":
        return {(i + 1, i + len(value)) for i in range(n - len(value) + 1) if all(v is None or words[i + k] in ([v] if isinstance(v, str) else v) for k, v in enumerate(value))}
    if name in ("near", "then"):
        found = each[0]
        for other in each[1:]:
            found = {(min(a[0], b[0]), max(a[1], b[1])) for a in found for b in other if 0 <= b[0] - a[1] - 1 <= rest["distance"] or (name == "near" and 0 <= a[0] - b[1] - 1 <= rest["distance"])}
        return found
    if name in ("and", "all_of", "or", "any_of", "at_least"):
        needed = {"and": len(each), "all_of": len(each), "at_least": rest.get("count", 1)}.get(name, 1)
        return set().union(*each) if sum(bool(s) for s in each) >= needed else set()
    if name == "and_not":
        return each[0] if not each[1] else set()
    if name in ("in_first", "in_last"):
        return {s for s in spans(value, words) if (s[1] <= rest["words"] if name == "in_first" else s[0] > n - rest["words"])}
    if name == "in_words":
        return {s for s in spans(value, words) if rest["from"] <= s[0] and s[1] <= rest["to"]}
    if name == "within":
        return {s for s in spans(value, words) if s[1] - s[0] + 1 <= rest["words"]}
    tests = {
        "encloses": lambda a, b: a[0] <= b[0] and b[1] <= a[1],
        "enclosed_by": lambda a, b: b[0] <= a[0] and a[1] <= b[1],
        "overlapping": lambda a, b: a[0] <= b[1] and b[0] <= a[1],
        "before": lambda a, b: a[1] < b[0],
        "after": lambda a, b: a[0] > b[1],
    }
    test, wanted = tests[name.removeprefix("not_")], not name.startswith("not_")
    return {a for a in each[0] if any(test(a, b) for b in each[1]) == wanted}


def made(rng, depth):
    """A random expression."""
    word = lambda: rng.choice(WORDS)
    if depth == 0 or rng.random() < 0.15:
        return rng.choice([word(), f"{word()} {word()}", {"phrase": [word(), None, [word(), word()]]}])
    sub = lambda: made(rng, depth - 1)
    name = rng.choice(["near", "then", "and", "or", "all_of", "any_of", "at_least", "and_not", "in_first", "in_last", "in_words", "within", "encloses", "not_encloses", "enclosed_by", "not_enclosed_by", "overlapping", "not_overlapping", "before", "after"])
    if name in ("near", "then"):
        return {name: [sub(), sub()], "distance": rng.randint(0, 3)}
    if name == "at_least":
        return {name: [sub(), sub(), sub()], "count": rng.randint(1, 3)}
    if name in ("in_first", "in_last", "within"):
        return {name: sub(), "words": rng.randint(1, 5)}
    if name == "in_words":
        first = rng.randint(1, 5)
        return {name: sub(), "from": first, "to": first + rng.randint(0, 4)}
    return {name: [sub(), sub()]}


def test_expressions_match_as_the_plain_evaluator_says(spark):
    rng = random.Random(77)
    sentences = [[rng.choice(WORDS) for _ in range(rng.randint(0, 11))] for _ in range(60)]
    expressions = [made(rng, 1 + k % 2) for k in range(48)]
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(sentences)], "id int, body string").withColumn("words", F.when(F.col("body") == "", F.array().cast("array<string>")).otherwise(F.split("body", " ")))
    for first in range(0, len(expressions), 12):
        part = expressions[first : first + 12]
        rows = df.select("id", *(compiled(e)[1].hit(F.col("words")).alias(f"m{k}") for k, e in enumerate(part))).collect()
        for k, e in enumerate(part):
            assert {r.id for r in rows if r[f"m{k}"]} == {i for i, w in enumerate(sentences) if spans(e, w)}, e


def test_what_is_printed_reads_as_the_same_expression(spark):
    rng = random.Random(5)
    sentences = [[rng.choice(WORDS) for _ in range(rng.randint(1, 9))] for _ in range(40)]
    df = spark.createDataFrame([(k, w) for k, w in enumerate(sentences)], "id int, words array<string>")
    plain = [e for e in (made(rng, 2) for _ in range(40)) if "not_" not in str(e) and "enclosed" not in str(e)][:12]
    rows = df.select(*(F.struct(compiled(e)[1].hit(F.col("words")).alias("a"), parsed(compiled(e)[0]).hit(F.col("words")).alias("b")).alias(f"m{k}") for k, e in enumerate(plain))).collect()
    for k, e in enumerate(plain):
        assert all(r[f"m{k}"].a == r[f"m{k}"].b for r in rows), compiled(e)[0]


def test_printed_forms():
    assert compiled({"then": ["ash", "oak tree"], "distance": 4})[0] == '("ash") THEN/4 ("oak tree")'
    assert compiled({"in_last": "yew", "words": 3})[0] == '("yew") IN LAST 3 WORDS'
    assert compiled({"boost": {"any_of": ["fir", "elm"]}, "factor": 4})[0] == '([("fir") ("elm")])^4'
    assert compiled("a_b")[0] == '"a\\_b"'


@pytest.mark.parametrize(
    "expression",
    [{"near": ["ash"], "distance": -3}, {"then": ["ash", None], "distance": 1}, {"boost": "ash", "factor": -2}, {"in_last": "ash", "words": 0}, {"in_first": "ash", "percent": 140}, {"at_least": ["ash", "oak"], "count": 1, "percent": 30}, {"or": []}, {"raw": "NOT ash"}, {"raw": "ash", "extra": 1}, {"matches": "a s"}, {"unheard": "ash"}, 7, None],
)
def test_expressions_that_are_refused(expression):
    with pytest.raises(InvalidQueryError):
        compiled(expression)
