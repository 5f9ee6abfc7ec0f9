"""Python: classes, functions and methods by the standard library's parser, by indentation where that fails."""

from __future__ import annotations

import ast
import re
import warnings

from navspark.sources.extract.lexer import Symbol, mask

_LITERALS = r"(?P<literal>\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)|\#[^\n]*"
_DEFINITION = re.compile(r"^([ \t]*)(class|(?:async[ \t]+)?def)[ \t]+([^\W\d]\w*)", re.M)


def visibility(name: str) -> str:
    dunder = name.startswith("__") and name.endswith("__")
    return "private" if name.startswith("_") and not dunder else "public"


def _symbol(name: str, is_class: bool, line: int, end: int, scope: list[str], in_class: bool) -> Symbol:
    kind = "class" if is_class else ("method" if in_class else "function")
    return Symbol(name, kind, line, end, ".".join(scope) or None, visibility(name))


def _walk(nodes, scope: list[str], in_class: bool, out: list[Symbol]) -> None:
    for node in nodes:
        if isinstance(node, ast.ClassDef):
            out.append(_symbol(node.name, True, node.lineno, node.end_lineno, scope, in_class))
            _walk(node.body, [*scope, node.name], True, out)
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out.append(_symbol(node.name, False, node.lineno, node.end_lineno, scope, in_class))
        elif isinstance(node, (ast.stmt, ast.excepthandler, ast.match_case)):  # if, try, with and so on keep the scope
            _walk([c for c in ast.iter_child_nodes(node) if isinstance(c, (ast.stmt, ast.excepthandler, ast.match_case))], scope, in_class, out)


def _by_indent(source: str) -> list[Symbol]:
    text = mask(source, _LITERALS)
    lines = text.split("\n")
    out: list[Symbol] = []
    open_blocks: list[tuple[int, str, bool]] = []  # last line, name, is a class
    for m in _DEFINITION.finditer(text):
        is_class, line = m[2] == "class", text.count("\n", 0, m.start(2)) + 1
        while open_blocks and open_blocks[-1][0] < line:
            open_blocks.pop()
        if any(not c for _, _, c in open_blocks):
            continue  # inside a function's body
        end = line
        for n in range(line, len(lines)):
            if lines[n].strip():
                if len(lines[n]) - len(lines[n].lstrip()) <= len(m[1]):
                    break
                end = n + 1
        scope = [name for _, name, _ in open_blocks]
        out.append(_symbol(m[3], is_class, line, end, scope, bool(scope)))
        open_blocks.append((end, m[3], is_class))
    return out


def extract(source: str) -> list[Symbol]:
    out: list[Symbol] = []
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            _walk(ast.parse(source).body, [], False, out)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return _by_indent(source)
    return out
