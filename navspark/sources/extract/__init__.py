"""Extractors: source text to definitions, one module per language. They never fail on broken source."""

from __future__ import annotations

from collections.abc import Callable

from navspark.sources.extract import ecma, golang, python, ruby, rust
from navspark.sources.extract.lexer import Symbol

EXTRACTORS: dict[str, Callable[[str], list[Symbol]]] = {
    "ruby": ruby.extract,
    "rust": rust.extract,
    "go": golang.extract,
    "python": python.extract,
    "typescript": ecma.extract,
    "javascript": ecma.extract,
}


def extract(language: str, source: str) -> list[Symbol]:
    """Definitions in order of their place; none for an unknown language or a source that cannot be read."""
    function = EXTRACTORS.get(language)
    try:
        return function(source) if function and source.strip() else []
    except (RecursionError, IndexError):
        return []
