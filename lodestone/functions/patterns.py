"""Patterns as PostgreSQL writes them, for Java."""

from __future__ import annotations

import re

from ..errors import UnsupportedError

#: Bracket classes and their Java names (fixed values).
CLASSES = {"alpha": "Alpha", "digit": "Digit", "alnum": "Alnum", "upper": "Upper", "lower": "Lower", "punct": "Punct", "space": "Space", "blank": "Blank", "cntrl": "Cntrl", "graph": "Graph", "print": "Print", "xdigit": "XDigit"}
#: Escapes that mean something else in Java (fixed values).
ESCAPES = {"y": r"\b", "Y": r"\B", "m": r"\b(?=\w)", "M": r"\b(?<=\w)", "Z": r"\z", "A": r"\A"}


def java_regex(pattern: str) -> str:
    """An unanchored POSIX-style pattern for rlike: dots match newlines and $ only the very end."""
    if not isinstance(pattern, str):
        raise UnsupportedError("patterns are given as strings")
    flags, rest = "(?s)", pattern
    if head := re.match(r"\(\?([a-z]+)\)", pattern):
        rest = pattern[head.end() :]
        flags = "(?" + "".join(sorted(set(head[1]) & set("ix")) + (["m"] if "n" in head[1] else ["s"])) + ")"
    out, i, inside = [], 0, False
    while i < len(rest):
        c = rest[i]
        if inside and (named := re.match(r"\[:(\^?)(\w+):\]", rest[i:])):
            out.append(f"\\{'P' if named[1] else 'p'}{{{CLASSES.get(named[2], named[2])}}}")
            i += named.end()
            continue
        if c == "\\" and i + 1 < len(rest):
            out.append(ESCAPES.get(rest[i + 1], c + rest[i + 1]) if not inside else c + rest[i + 1])
            i += 2
            continue
        if inside and c == "]":
            inside = False
        elif inside and c in "[&":
            out.append("\\")
        elif c == "[":
            inside = True
            step = 2 if rest[i + 1 : i + 2] == "^" else 1
            out.append(rest[i : i + step])
            i += step
            if rest[i : i + 1] == "]":
                out.append("\\]")
                i += 1
            continue
        elif c == "$" and not inside and "m" not in flags:
            c = r"\z"
        out.append(c)
        i += 1
    return flags + "".join(out)


def like_pattern(pattern: str) -> str:
    """A LIKE pattern in which a backslash escapes % and _ only; others are doubled for Spark."""
    return re.sub(r"\\(?![%_])", r"\\\\", pattern)
