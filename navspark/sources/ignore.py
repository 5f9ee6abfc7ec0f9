"""Ignore rules: what the lines of .gitignore files mean, as anchored patterns of which the last that fits a path decides.

The patterns are written so that Python and Spark read them alike: the walk of a tree tests them in its partitions, `is_ignored` in a plan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """pattern: anchored, over paths relative to the tree's root. negated: takes an earlier rule back. folders: fits folders only."""

    pattern: str
    negated: bool
    folders: bool


def _literal(text: str) -> str:
    return "".join(c if c.isalnum() or ord(c) > 127 or c == "_" else f"\\{c}" for c in text)


def _segment(glob: str) -> str:
    """One part of a path: * any run, ? one character, [] a class, \\ takes the next character as it is; a [ that nothing closes is itself."""
    out, k = "", 0
    while k < len(glob):
        c = glob[k]
        close = glob.find("]", k + 2 + (glob[k + 1 : k + 2] in ("!", "^"))) if c == "[" else -1
        if c == "*":
            out += "[^/]*" if not out.endswith("[^/]*") else ""
        elif c == "?":
            out += "[^/]"
        elif close > 0:
            inner = glob[k + 1 : close]
            negated, inner = inner[0] in "!^", inner.lstrip("!^") if inner[0] in "!^" else inner
            body = "".join(x if x == "-" and 0 < n < len(inner) - 1 else _literal(x) for n, x in enumerate(inner))
            out += f"(?!/)[{'^' if negated else ''}{body}]"
            k = close
        elif c == "\\" and k + 1 < len(glob):
            k += 1
            out += _literal(glob[k])
        else:
            out += _literal(c)
        k += 1
    return out


def rule_of(line: str, base: str = "") -> Rule | None:
    """What a line of the ignore file in the folder ``base`` means; None for blank lines and comments.

    A pattern with a slash before its end counts from the folder, another at any depth below it; ** stands for any folders; a trailing slash means
    folders only; a leading ! takes back; # and ! begin a pattern after a backslash; trailing spaces count after a backslash only.
    """
    text = line.rstrip("\r\n")
    while text.endswith((" ", "\t")) and not text.endswith("\\ "):
        text = text[:-1]
    if not text or text.startswith("#"):
        return None
    negated, text = text.startswith("!"), text.removeprefix("!")
    folders, text = text.endswith("/"), text.rstrip("/") if text.endswith("/") else text
    if not text:
        return None
    below = _literal(base.rstrip("/")) + "/" if base else ""
    if "/" not in text:
        return Rule(f"^{below}(?:.*/)?{_segment(text)}$", negated, folders)
    parts, out = text.removeprefix("/").split("/"), f"^{below}"
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        out += (".+" if last else "(?:.*/)?") if part == "**" else _segment(part) + ("" if last else "/")
    return Rule(out + "$", negated, folders)


def rules_of(text: str, base: str = "") -> list[Rule]:
    return [r for line in text.split("\n") if (r := rule_of(line, base))]


def fits_last(rules: list[Rule], path: str, is_folder: bool) -> bool:
    """Whether the last rule that fits says to ignore. What lies in a folder that is ignored is not asked about: nothing can take it back."""
    for rule in reversed(rules):
        if (is_folder or not rule.folders) and re.match(rule.pattern, path, re.DOTALL):
            return not rule.negated
    return False


def is_ignored(path: Column, rules: list[Rule]) -> Column:
    """Whether a file's path, or any folder above it, is ignored. One native expression for all rules, without a join."""

    def last(p: Column, is_folder: bool) -> Column:
        numbers = [F.when(p.rlike(f"(?s){r.pattern}"), n).otherwise(0) for n, r in enumerate(rules, 1) if is_folder or not r.folders]
        found = F.greatest(F.lit(0), F.lit(0), *numbers)
        return found.isin([n for n, r in enumerate(rules, 1) if not r.negated])

    if not rules:
        return F.lit(False)
    depth = F.size(F.split(path, "/"))
    above = F.when(depth > 1, F.transform(F.sequence(F.lit(1), depth - 1), lambda k: F.array_join(F.slice(F.split(path, "/"), F.lit(1), k), "/")))
    return F.coalesce(F.exists(above, lambda f: last(f, True)), F.lit(False)) | last(path, False)
