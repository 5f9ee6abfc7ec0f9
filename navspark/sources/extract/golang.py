"""Go: functions, methods with their receiver's type, structs, interfaces and their methods."""

from __future__ import annotations

from navspark.sources.extract.lexer import Symbol, Tokens, is_name, mask

_LITERALS = r"//[^\n]*|/\*.*?(?:\*/|\Z)|(?P<literal>`[^`]*(?:`|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)"


def _seen(name: str) -> str:
    return "public" if name[:1].isupper() else "private"


def _end_of_statement(t: Tokens, n: int, end: int) -> int:
    """The last token of a declaration that begins at n: to the end of its line, over what it opens."""
    last = n
    while n < end and (t.line(n) == t.line(last) or t.text[n] in ".,"):
        last = t.past(n) - 1
        n = last + 1
    return last


def extract(source: str) -> list[Symbol]:
    t = Tokens(mask(source, _LITERALS))
    out: list[Symbol] = []

    def add(name, kind, first, last, parent=None):
        out.append(Symbol(name, kind, t.line(first), t.line(last), parent, _seen(name)))

    def type_spec(n: int, end: int, first: int) -> int:
        """``Name[T any] struct {...}`` and the like; gives the token after it."""
        name, k = t.get(n), n + 1
        if t.get(k) == "[" and is_name(t.get(k + 1)) and t.get(k + 2) != "]":
            k = t.past(k)
        last = _end_of_statement(t, n, end)
        if t.get(k) in ("struct", "interface") and t.get(k + 1) == "{":
            close = t.close.get(k + 1, end - 1)
            add(name, "struct" if t.get(k) == "struct" else "trait", first, close)
            if t.get(k) == "interface":
                m = k + 2
                while m < close:
                    stop = _end_of_statement(t, m, close)
                    if is_name(t.get(m)) and t.get(m + 1) == "(":
                        add(t.get(m), "method", m, stop, name)
                    m = stop + 1
            return close + 1
        return last + 1

    n = 0
    while n < len(t):
        word = t.text[n]
        if word == "func" and (is_name(t.get(n + 1)) or t.get(n + 1) == "("):
            k, parent = n + 1, None
            if t.get(k) == "(":
                inside = [x for x in t.text[k + 1 : t.close.get(k, k)] if is_name(x)]
                starts = t.text[k + 1 : t.close.get(k, k)]
                named = len(starts) > 1 and is_name(starts[0]) and starts[1] not in ("[", ".", ")")
                parent = next(iter(inside[1:] if named else inside), None)
                k = t.past(k)
            if is_name(t.get(k)):
                name, m = t.get(k), k + 1
                while m < len(t) and t.text[m] in "([" and t.same_line(m, t.close.get(m, m)) or t.get(m) == "(":
                    m = t.past(m)
                while m < len(t) and t.text[m] != "{" and t.line(m) == t.line(m - 1):
                    m = m + 2 if t.text[m] in ("struct", "interface") and t.get(m + 1) == "{" else t.past(m)
                last = t.close.get(m, m) if t.get(m) == "{" else m - 1
                add(name, "method" if parent else "function", n, last, parent)
                n = last + 1
                continue
        elif word == "type":
            if t.get(n + 1) == "(":
                end = t.close.get(n + 1, len(t))
                k = n + 2
                while k < end:
                    k = type_spec(k, end, k) if is_name(t.get(k)) else k + 1
                n = end + 1
                continue
            if is_name(t.get(n + 1)):
                n = type_spec(n + 1, len(t), n + 1)
                continue
        n = t.past(n)
    return out
