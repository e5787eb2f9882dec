"""Which columns and which parts of nested values a hit shows."""

from __future__ import annotations

import re


def _matcher(patterns) -> re.Pattern | None:
    if not patterns:
        return None
    listed = [patterns] if isinstance(patterns, str) else list(patterns)
    return re.compile("|".join(f"(?:{re.escape(str(p)).replace(chr(92) + '*', '.*')})" for p in listed) + r"\Z")


class SourceFilter:
    """includes and excludes with * for anything, dots included; excludes win, and a parent takes what it holds."""

    def __init__(self, select):
        if isinstance(select, dict):
            includes, excludes = select.get("includes"), select.get("excludes")
        else:
            includes, excludes = select, None
        self.nothing = includes in ([], ())
        self.all = select is None or select is True or select is False
        self.includes = None if self.all else _matcher(includes)
        self.excludes = None if self.all else _matcher(excludes)

    def _in(self, path: str) -> bool:
        return self.includes is None or self._hit(self.includes, path)

    @staticmethod
    def _hit(pattern: re.Pattern, path: str) -> bool:
        names = path.split(".")
        return any(pattern.fullmatch(".".join(names[: k + 1])) for k in range(len(names)))

    def columns(self, names: list[str]) -> list[str]:
        """The columns that can hold something selected, so that only they are read."""
        if self.all:
            return names
        if self.nothing:
            return []
        wanted = [n for n in names if self._in(n) or (self.includes is not None and any(p.strip("(?:)").split(".")[0] == re.escape(n) or r".*" in p for p in self.includes.pattern.removesuffix(r"\Z").split("|")))]
        return [n for n in wanted if not (self.excludes and self._hit(self.excludes, n))]

    def __call__(self, row: dict) -> dict:
        if self.all:
            return row
        if self.nothing:
            return {}
        out = {}
        for name, value in row.items():
            found, kept = self._part(name, value)
            if kept:
                out[name] = found
        return out

    def _part(self, path: str, value):
        if self.excludes and self._hit(self.excludes, path):
            return None, False
        if isinstance(value, dict) and value:
            inner = {}
            for k, v in value.items():
                found, kept = self._part(f"{path}.{k}", v)
                if kept:
                    inner[k] = found
            return inner, self._in(path) or bool(inner)
        if isinstance(value, list) and any(isinstance(v, (dict, list)) for v in value):
            parts = [self._part(path, v) for v in value]
            inner = [f for f, kept in parts if kept and not (isinstance(f, (dict, list)) and not f)]
            return inner, self._in(path) or bool(inner)
        return value, self._in(path)
