"""Masking and tokens for the hand-written extractors. Nothing here raises on broken source."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

OPEN, CLOSE = "([{", ")]}"
_TOKEN = re.compile(r"[^\W\d][\w$]*|[$#@][^\W\d][\w$]*|=>|->|::|[^\s\w]|\w+")


@dataclass(frozen=True)
class Symbol:
    name: str
    kind: str
    line: int
    end_line: int
    parent: str | None = None
    visibility: str | None = None


def blank(text: str) -> str:
    """Spaces for everything but line ends."""
    return re.sub(r"[^\n]", " ", text)


def mask(source: str, patterns: str, keep: str = "") -> str:
    """The source with comments and literals blanked, places unchanged. A literal is left as a pair of ``keep`` at its ends."""

    def cover(m: re.Match) -> str:
        text = blank(m[0])
        if keep and m.lastgroup == "literal" and len(text) > 1:
            return keep + text[1:-1] + keep
        return text

    return re.sub(patterns, cover, source, flags=re.S)


class Tokens:
    """Tokens of masked source with their places, and for each bracket the token that closes it."""

    def __init__(self, text: str):
        found = list(_TOKEN.finditer(text))
        self.text = [m[0] for m in found]
        self.at = [m.start() for m in found]
        self.ends = [m.end() for m in found]
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        self.close = {}
        stack: list[int] = []
        for n, t in enumerate(self.text):
            if t in OPEN:
                stack.append(n)
            elif t in CLOSE:
                want = OPEN[CLOSE.index(t)]
                while stack and self.text[stack[-1]] != want:  # an unclosed one in between
                    stack.pop()
                if stack:
                    self.close[stack.pop()] = n

    def __len__(self) -> int:
        return len(self.text)

    def get(self, n: int) -> str:
        return self.text[n] if 0 <= n < len(self.text) else ""

    def line(self, n: int) -> int:
        return bisect_right(self.breaks, self.at[min(n, len(self.at) - 1)] - 1) + 1

    def same_line(self, a: int, b: int) -> bool:
        return self.line(a) == self.line(b)

    def past(self, n: int) -> int:
        """The token after this one, or after what it opens."""
        return self.close.get(n, n) + 1

    def find(self, n: int, end: int, wanted: str) -> int:
        """The next of the wanted one-character tokens at this depth, or ``end``."""
        while n < end and self.text[n] not in wanted:
            n = self.past(n)
        return min(n, end)


def is_name(token: str) -> bool:
    return bool(token) and (token[0].isalpha() or token[0] in "_$") and token != "_"
