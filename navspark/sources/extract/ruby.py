"""Ruby: classes, modules, methods, and the macros that define methods."""

from __future__ import annotations

import re
from dataclasses import replace

from navspark.sources.extract.lexer import Symbol, blank, mask

_LITERALS = (
    r"^=begin\b.*?(?:^=end[^\n]*|\Z)|^__END__$.*|(?P<literal>\"(?:\\.|[^\"\\])*(?:\"|\Z)|'(?:\\.|[^'\\])*(?:'|\Z)|`(?:\\.|[^`\\])*(?:`|\Z)"
    r"|(?<![\w)\]])%[qQwWiI]?(?:\([^)]*\)|\[[^\]]*\]|\{[^}]*\}|<[^>]*>|\|[^|]*\|))|\#(?!\{)[^\n]*"
)
_HEREDOC = re.compile(r"<<([~-]?)(['\"`]?)([A-Z_a-z]\w*)\2")
_REGEX = re.compile(r"(?<=[=(,~!|&\[{])\s*/(?:\\.|[^/\\\n])+/[a-z]*")
#: Words that open a block wherever they begin a statement or a value; `do` opens one anywhere.
_OPENERS = re.compile(r"(?:(?:^|[=;(,\[{]|\b(?:then|else|do|and|or|not|begin)\b|&&|\|\|)\s*)(if|unless|case|while|until|for|begin)\b")
_DO, _END = re.compile(r"\bdo\b(?!:)"), re.compile(r"(?<![.:\w@$])end\b(?![?!:])")
_LOOP = re.compile(r"^\s*(?:while|until|for)\b")
_NAMES = re.compile(r":([A-Za-z_]\w*[?!=]?)|:\"(\w+[?!=]?)\"|\"(\w+[?!=]?)\"|'(\w+[?!=]?)'")
#: Macros that define a method for each of their names, and those that do for the first.
ALL_NAMES = ("attr_accessor", "attr_reader", "attr_writer", "delegate")
FIRST_NAME = ("define_method", "alias_method", "scope", "has_many", "has_one", "belongs_to", "field")
_MACRO = re.compile(rf"^\s*({'|'.join(ALL_NAMES + FIRST_NAME)})\b\s*\(?\s*(.*)$", re.S)
_CLASS = re.compile(r"^\s*(class|module)\s+((?:::)?[A-Z]\w*(?:::[A-Z]\w*)*)")
_DEF = re.compile(r"^\s*(?:(private|protected|public|private_class_method|module_function)\s+)?def\s+(?:(self|[A-Z]\w*)\.)?([A-Za-z_]\w*[?!=]?|\[\]=?|[+\-*/%<>=!~^&|]+)")
_SECTION = re.compile(r"^\s*(private|protected|public)\s*(?:$|;)")


def _mask_heredocs(source: str) -> str:
    lines = source.split("\n")
    n = 0
    while n < len(lines):
        for _, _, tag in _HEREDOC.findall(lines[n]):
            k = n + 1
            while k < len(lines) and lines[k].strip() != tag:
                lines[k] = blank(lines[k])
                k += 1
            if k < len(lines):
                lines[k] = blank(lines[k])
        n += 1
    return "\n".join(lines)


def _literal_names(arguments: str, all_of_them: bool) -> list[str]:
    """Names given as symbols or strings, up to the first keyword argument; none if the first argument is computed."""
    out = []
    for part in _split_arguments(arguments):
        m = _NAMES.match(part)
        if not m or part[m.end() :].strip()[:2] == "=>":
            break
        out.append(next(g for g in m.groups() if g))
        if not all_of_them:
            break
    return out


def _split_arguments(text: str) -> list[str]:
    depth, parts, now = 0, [], ""
    for c in text:
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if depth < 0:
                break
        if c == "," and depth == 0:
            parts.append(now.strip())
            now = ""
        elif c == "\n" and depth == 0 and not (now.strip() == "" and parts):
            break
        else:
            now += c
    return [*parts, now.strip()]


def extract(source: str) -> list[Symbol]:
    source = _mask_heredocs(source)
    masked = re.sub(_LITERALS, lambda m: blank(m[0]), source, flags=re.S | re.M)
    masked = _REGEX.sub(lambda m: blank(m[0]), masked)
    lines, raw = masked.split("\n"), source.split("\n")
    out: list[Symbol] = []
    #: open blocks: (index in out or None, scope of a class or module or None, [visibility of the section], whether it is a method)
    stack: list[tuple[int | None, str | None, list[str], bool]] = []

    def scope() -> str | None:
        return next((b[1] for b in reversed(stack) if b[1]), None)

    def section() -> list[str]:
        return stack[-1][2] if stack else top

    top = ["public"]
    for n, line in enumerate(lines, 1):
        opened: list[tuple[int | None, str | None, list[str], bool]] = []
        in_def = any(b[3] for b in stack)
        c, d = _CLASS.match(line), _DEF.match(line)
        section_here = section()
        if c and not in_def:
            *prefix, name = c[2].removeprefix("::").split("::")
            outer = scope()
            parent = "::".join(prefix if c[2].startswith("::") else [*([outer] if outer else []), *prefix]) or None
            out.append(Symbol(name, c[1], n, n, parent, "public"))
            opened.append((len(out) - 1, f"{parent}::{name}" if parent else name, ["public"], False))
        elif re.match(r"^\s*class\s*<<", line):
            opened.append((None, None, ["public"], False))
        elif d:
            if not in_def:
                marked = {"private": "private", "protected": "protected", "public": "public"}.get(d[1] or "", section_here[0])
                seen = "public" if d[2] else marked
                out.append(Symbol(d[3], "method", n, n, scope(), seen))
            index = len(out) - 1 if not in_def else None
            rest = line[d.end() :]
            endless = re.match(r"\s*(?:\([^)]*\))?\s*=(?!=|~|>)", rest) and not d[3].endswith("=")
            if not endless:
                opened.append((index, None, section_here, True))
        elif not in_def:
            s, m = _SECTION.match(line), _MACRO.match(line)
            if s:
                section_here[0] = s[1]
            if m:
                k, text = n, raw[n - 1][line.index(m[1]) + len(m[1]) :].strip()
                text = text[1:] if text.startswith("(") else text
                while (text.count("(") > text.count(")") or re.search(r",\s*$", lines[k - 1])) and k < len(raw):
                    k += 1
                    text += "\n" + raw[k - 1]
                for name in _literal_names(text, m[1] in ALL_NAMES):
                    out.append(Symbol(name, "method", n, k, scope(), section_here[0]))
        plain = len(_OPENERS.findall(line))
        loops = bool(_LOOP.match(line))
        plain += max(0, len(_DO.findall(line)) - loops)
        opened += [(None, None, section_here, False)] * plain
        stack += opened
        for _ in _END.findall(line):
            index = stack.pop()[0] if stack else None
            if index is not None:
                out[index] = replace(out[index], end_line=n)
    return out
