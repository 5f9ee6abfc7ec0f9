"""TypeScript and JavaScript: classes, interfaces, type aliases, enums, namespaces, functions, function-valued variables, members."""

from __future__ import annotations

from navspark.sources.extract.lexer import Symbol, Tokens, is_name, mask

_LITERALS = (
    r"//[^\n]*|/\*.*?(?:\*/|\Z)|(?P<literal>`(?:\\.|[^`\\])*(?:`|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)"
    r"|(?:(?<=[=(,:;!&|?{}\[])|(?<=return)|(?<=typeof))[ \t]*/(?![*/ ])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*"
)
_MODIFIERS = {"public", "private", "protected", "static", "readonly", "abstract", "override", "async", "declare", "get", "set", "accessor"}
_NOT_MEMBERS = {"if", "for", "while", "switch", "catch", "return", "with", "function", "new", "typeof", "await", "super"}


def extract(source: str) -> list[Symbol]:
    t = Tokens(mask(source, _LITERALS, keep='"'))
    out: list[Symbol] = []

    def statement_end(n: int, end: int) -> int:
        """The last token of a statement without a body of its own: its semicolon, or where a line ends between operands."""
        k = n
        while k < end:
            if t.text[k] == ";":
                return k
            k = t.past(k)
            if k < end and t.line(k) != t.line(k - 1) and not _goes_on(k):
                return k - 1
        return end - 1

    def _goes_on(k: int) -> bool:
        joins = {"=", ",", "=>", "?", ":", "|", "&", "+", "-", "*", ".", "<", ">", "extends", "=="}
        return t.text[k] in joins or t.get(k - 1) in joins | {"("}

    def body_from(n: int, end: int) -> int:
        """The brace that opens a body, over parameters and types; ``end`` if a statement ends before it."""
        while n < end and t.text[n] not in "{;":
            if t.text[n] == ":" and t.get(n + 1) == "{":  # a type in braces
                n += 1
            n = t.past(n)
        return n if n < end and t.text[n] == "{" else end

    def is_function(n: int, end: int) -> bool:
        """Whether an initializer is a function or an arrow function."""
        if t.get(n) == "async":
            n += 1
        if t.get(n) == "function":
            return True
        if is_name(t.get(n)) and t.get(n + 1) == "=>":
            return True
        if t.get(n) == "<":
            n = t.find(n, end, "(;")
        if t.get(n) != "(":
            return False
        k = t.past(n)
        if t.get(k) == ":":
            while k < end and t.text[k] not in ("=>", ";", "="):
                k = t.past(k)
        return t.get(k) == "=>"

    def function_end(n: int, end: int) -> int:
        last = statement_end(n, end)
        return last

    def members(n: int, end: int, scope: str, interface: bool) -> None:
        while n < end:
            first, seen, k = n, "public", n
            while t.get(k).startswith("@"):
                k = k + 1
                while t.get(k) == ".":
                    k += 2
                if t.get(k) == "(":
                    k = t.past(k)
                first = k
            while t.get(k) in _MODIFIERS and t.get(k + 1) not in ("(", "=", ":", ";", "?", "<", "}", ","):
                if t.get(k) in ("private", "protected"):
                    seen = t.get(k)
                k += 1
            if t.get(k) == "*":
                k += 1
            name = t.get(k)
            if name.startswith("#"):
                seen = "private"
            plain = name.removeprefix("#")
            m = k + 1
            if t.get(m) in ("?", "!"):
                m += 1
            if is_name(plain) and plain not in _NOT_MEMBERS and t.get(m) in ("(", "<"):
                m = t.find(m, end, "(") if t.get(m) == "<" else m
                after = t.past(m)
                brace = body_from(after, end) if not interface else end
                line_end = statement_end(after - 1, end)
                has_body = not interface and brace < end and brace <= max(line_end, brace) and ";" not in t.text[after:brace]
                last = t.close.get(brace, end - 1) if has_body else line_end
                out.append(Symbol(plain, "method", t.line(first), t.line(last), scope, seen))
                n = last + 1
                continue
            if is_name(plain) and t.get(m) in ("=", ":"):
                eq = m if t.get(m) == "=" else t.find(m, end, "=;")
                last = statement_end(k, end)
                if t.get(eq) == "=" and eq <= last and is_function(eq + 1, end):
                    out.append(Symbol(plain, "method", t.line(first), t.line(last), scope, seen))
                n = last + 1
                continue
            n = t.past(max(n, k))

    def walk(n: int, end: int, scope: str | None) -> None:
        while n < end:
            first, seen = n, "private"
            k = n
            if t.get(k) == "export":
                seen, k = "public", k + 1
                if t.get(k) == "default":
                    k += 1
            while t.get(k) in ("declare", "abstract", "async") and t.get(k + 1) not in ("(", "=", ".", "=>"):
                k += 1
            word, name = t.get(k), t.get(k + 1)
            if word == "function":
                if name == "*":
                    k, name = k + 1, t.get(k + 2)
                brace = body_from(k + 1, end)
                last = t.close.get(brace, end - 1) if brace < end else statement_end(k, end)
                if is_name(name):
                    out.append(Symbol(name, "function", t.line(first), t.line(last), scope, seen))
                n = last + 1
            elif word in ("class", "interface", "enum", "namespace", "module") and is_name(name) or (word == "const" and name == "enum"):
                if word == "const":
                    k, word, name = k + 1, "enum", t.get(k + 2)
                brace = t.find(k + 2, end, "{;")
                if t.get(brace) != "{":
                    n = brace + 1
                    continue
                last = t.close.get(brace, end - 1)
                kind = {"class": "class", "interface": "trait", "enum": "enum"}.get(word, "module")
                out.append(Symbol(name, kind, t.line(first), t.line(last), scope, seen))
                inner = f"{scope}.{name}" if scope else name
                if word in ("class", "interface"):
                    members(brace + 1, last, inner, word == "interface")
                elif kind == "module":
                    walk(brace + 1, last, inner)
                n = last + 1
            elif word == "type" and is_name(name) and t.get(k + 2) in ("=", "<"):
                last = statement_end(k, end)
                out.append(Symbol(name, "struct", t.line(first), t.line(last), scope, seen))
                n = last + 1
            elif word in ("const", "let", "var"):
                last = statement_end(k, end)
                m = k + 1
                while m <= last:
                    if is_name(t.get(m)):
                        eq = t.find(m + 1, last + 1, "=,;")
                        if t.get(eq) == "=" and is_function(eq + 1, last + 1):
                            out.append(Symbol(t.get(m), "function", t.line(first), t.line(last), scope, seen))
                    m = t.find(m, last + 1, ",;") + 1
                n = last + 1
            elif word == "{" and t.get(k - 1) == "default":  # an exported object: its methods have no parent
                last = t.close.get(k, end - 1)
                object_methods(k + 1, last)
                n = last + 1
            elif word == "{":
                walk(k + 1, t.close.get(k, end), scope)
                n = t.past(k)
            elif word == "(":  # arguments, callbacks among them, are not looked into
                n = t.past(k)
                if t.get(n) == "{" or t.get(n) == "=>":
                    n = t.past(n + (t.get(n) == "=>"))
            else:
                n = t.past(max(n, k))

    def object_methods(n: int, end: int) -> None:
        while n < end:
            k = n + (t.get(n) in ("async", "get", "set", "*") and t.get(n + 1) != "(")
            if is_name(t.get(k)) and t.get(k + 1) == "(" and t.get(t.past(k + 1)) == "{":
                last = t.close.get(t.past(k + 1), end - 1)
                out.append(Symbol(t.get(k), "method", t.line(n), t.line(last), None, "private"))
                n = last + 1
            else:
                n = t.find(n, end, ",") + 1

    walk(0, len(t), None)
    return out
