"""What a user types, as a plan: query, filters, limits, waiting time. Plain driver-side parsing."""

from __future__ import annotations

import math
import os
import re
from dataclasses import dataclass, field

from navspark.functions.textcols import KIND_ALIASES, LANGUAGE_ALIASES
from navspark.operators.rank import headroom
from navspark.schemas import KINDS, LANGUAGES

#: Default budgets in milliseconds, each to be set by an environment variable NAVSPARK_<NAME>_MS.
BUDGETS = {"answer": 500, "deferred": 250, "fallback": 250, "warm": 20_000, "wait": 60_000}
_KEYWORDS = (*KINDS, "fn", "type", "interface")


def budget(name: str) -> float:
    """Seconds."""
    try:
        return float(os.environ.get(f"NAVSPARK_{name.upper()}_MS", "")) / 1000
    except ValueError:
        return BUDGETS[name] / 1000


def jobs(session: str | None, parallelism: int) -> int:
    """In how many parts a tree is listed and parsed: the session's spark.navspark.jobs, else NAVSPARK_JOBS, else what the cluster runs at once; what is no positive number is passed over."""
    for text in (session, os.environ.get("NAVSPARK_JOBS")):
        if text and text.strip().isdecimal() and int(text) > 0:
            return int(text)
    return max(parallelism, 1)


def canonical_kind(token: str) -> str:
    low = token.strip().lower()
    return KIND_ALIASES.get(low, low)


def canonical_langs(token: str) -> list[str]:
    low = token.strip().lower()
    if low in LANGUAGE_ALIASES:
        return [LANGUAGE_ALIASES[low]]
    return [x for x in LANGUAGES if x.startswith(low)] or [low]


def split_kind_keyword(words: list[str]) -> tuple[str | None, list[str]]:
    """``class Foo``, as one word or two, asks for a kind; a keyword alone is a query."""
    first, *rest = words[0].split(None, 1) if words else [""]
    if first.lower() in _KEYWORDS and (rest or len(words) > 1):
        return canonical_kind(first), ([rest[0], *words[1:]] if rest else words[1:])
    return None, words


def parse_wait(text: str) -> float | None:
    """Seconds of ``250ms``, ``1.5s``, ``2m`` or a bare number; None if it is none of those, negative or not finite."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d*)?|\.\d+)\s*(ms|s|m)?\s*", text)
    value = float(m[1]) * {"ms": 0.001, "s": 1, "m": 60, None: 1}[m[2]] if m else math.inf
    return value if math.isfinite(value) else None


def parse_choice(text: str, count: int) -> int | None:
    """0-based; an empty answer takes the first; None out of range."""
    if not text.strip():
        return 0
    return int(text) - 1 if text.strip().isdigit() and 1 <= int(text) <= count else None


@dataclass(frozen=True)
class QuerySpec:
    query: str
    kinds: tuple[str, ...] = ()
    langs: tuple[str, ...] = ()
    paths: tuple[str, ...] = ()
    limit: int = 10
    all_repos: bool = False
    extra: dict = field(default_factory=dict)

    @staticmethod
    def of(target: str, paths=(), kinds=(), langs=(), limit: int = 10, all_repos: bool = False) -> QuerySpec:
        kind, words = split_kind_keyword([target])
        if not words[0].strip():
            raise ValueError("an empty query matches everything")
        every = [canonical_kind(k) for text in kinds for k in text.split(",")] + ([kind] if kind else [])
        tongues = [x for text in langs for token in text.split(",") for x in canonical_langs(token)]
        return QuerySpec(words[0].strip(), tuple(every), tuple(tongues), tuple(paths), limit, all_repos)

    @property
    def filtered(self) -> bool:
        return bool(self.kinds or self.langs or self.paths)

    @property
    def ranked(self) -> int:
        """How many hits to rank before the filters."""
        return headroom(self.limit, self.filtered)
