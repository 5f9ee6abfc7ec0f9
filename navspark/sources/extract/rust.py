"""Rust: functions, methods, structs, enums, unions, traits and modules with a body; impl blocks give the parent."""

from __future__ import annotations

from navspark.sources.extract.lexer import Symbol, Tokens, is_name, mask

_LITERALS = (
    r"//[^\n]*|/\*.*?(?:\*/|\Z)|(?P<literal>b?r(?P<fence>\#*)\".*?(?:\"(?P=fence)|\Z)|b?\"(?:\\.|[^\"\\])*(?:\"|\Z)|b?'(?:\\(?:x..|u\{[^}]*\}|.)|[^\\'\n])')"
)
_PREFIXES = {"async", "const", "unsafe", "extern", "default", "safe"}


def _type_name(words: list[str]) -> str | None:
    """The last plain name of a type: without generics, path, references."""
    depth, name = 0, None
    for w in words:
        if w == "<":
            depth += 1
        elif w == ">":
            depth -= 1
        elif depth == 0:
            if w == "where":
                break
            if is_name(w) and w not in ("dyn", "mut", "const"):
                name = w
    return name


def extract(source: str) -> list[Symbol]:
    t = Tokens(mask(source, _LITERALS))
    out: list[Symbol] = []

    def walk(n: int, end: int, scope: str | None) -> None:
        def join(name: str) -> str:
            return f"{scope}::{name}" if scope else name

        while n < end:
            first = n
            while t.get(n) == "#" and t.get(n + 1) in ("[", "!"):
                n = t.past(n + 1 if t.get(n + 1) == "[" else n + 2)
                first = n
            seen = "private"
            if t.get(n) == "pub":
                seen, n = "public", n + 1
                if t.get(n) == "(":
                    seen, n = "crate", t.past(n)
            k = n
            while t.get(k) in _PREFIXES and k < end:
                k += 1
            word, name = t.get(k), t.get(k + 1)
            if word == "fn" and is_name(name):
                body = t.find(k + 2, end, "{;")
                last = t.close.get(body, body) if t.get(body) == "{" else min(body, end - 1)
                opened = t.find(k + 2, body, "(")
                first_argument = t.text[opened + 1 : t.find(opened + 1, t.close.get(opened, opened), ",")]
                method = "self" in first_argument
                out.append(Symbol(name, "method" if method else "function", t.line(first), t.line(last), scope, seen))
                n = last + 1
            elif word in ("struct", "enum", "union") and is_name(name):
                body = t.find(k + 2, end, "{;")
                last = t.close.get(body, body) if t.get(body) == "{" else min(body, end - 1)
                out.append(Symbol(name, "enum" if word == "enum" else "struct", t.line(first), t.line(last), scope, seen))
                n = last + 1
            elif word in ("trait", "mod") and is_name(name):
                body = t.find(k + 2, end, "{;")
                if t.get(body) != "{":
                    n = body + 1
                    continue
                last = t.close.get(body, end - 1)
                out.append(Symbol(name, "trait" if word == "trait" else "module", t.line(first), t.line(last), scope, seen))
                walk(body + 1, last, join(name))
                n = last + 1
            elif word == "impl":
                body = t.find(k + 1, end, "{;")
                if t.get(body) != "{":
                    n = body + 1
                    continue
                head = t.text[k + 1 : body]
                depth, cut = 0, 0
                for m, w in enumerate(head):
                    depth += (w == "<") - (w == ">")
                    if w == "for" and depth == 0 and head[m + 1 : m + 2] != ["<"]:
                        cut = m + 1
                words = head[cut:]
                if not cut and words[:1] == ["<"]:  # the impl's own generics
                    depth = 0
                    for m, w in enumerate(words):
                        depth += (w == "<") - (w == ">")
                        if depth == 0:
                            words = words[m + 1 :]
                            break
                name = _type_name(words)
                last = t.close.get(body, end - 1)
                walk(body + 1, last, join(name) if name else scope)
                n = last + 1
            elif word in ("use", "static", "type", "let") or (word and k > n and t.get(k - 1) == "const"):
                n = t.find(k, end, ";") + 1
            else:
                n = t.past(max(n, k)) if n < end else n + 1

    walk(0, len(t), None)
    return out
