"""Plain-Python versions of the operators, quadratic where that is the simple way."""

from __future__ import annotations

import re

import xxhash


def find(parent: dict, x):
    while parent[x] != x:
        x = parent[x]
    return x


def fingerprint(text: str | None, words: int) -> int:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    tokens = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not tokens:
        return 0
    shingles = [" ".join(tokens[k : k + words]) for k in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_duplicates(docs: list[tuple[int, str]], words: int, distance: int) -> dict[int, tuple[int, int]]:
    fps = {d: fingerprint(t, words) for d, t in docs}
    parent = {d: d for d in fps}
    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= distance:
                x, y = find(parent, a), find(parent, b)
                parent[max(x, y)] = min(x, y)
    return {d: (fps[d], find(parent, d)) for d in fps}
