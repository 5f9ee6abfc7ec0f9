"""Text functions of the catalog as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from navspark.schemas import KIND_BONUS, LANGUAGES, PARENT_BASE, PARENT_CAP, PARENT_STEP

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
EXTENSIONS = {ext: language for language, exts in LANGUAGES.items() for ext in exts}
#: Short and alternative names of kinds and languages.
KIND_ALIASES = {
    "c": "class", "m": "method", "f": "function", "fn": "function", "func": "function", "mod": "module", "s": "struct", "e": "enum", "t": "trait",
    "interface": "trait", "type": "struct",
}
LANGUAGE_ALIASES = {"rb": "ruby", "rs": "rust", "golang": "go", "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript"}


def ascii_lower(text: Column) -> Column:
    """A-Z only; queries are lowered like this, stored names by Unicode."""
    return F.translate(text, UPPER, LOWER)


def alnum_lower(text: Column) -> Column:
    """Letters and digits of any script, A-Z lowered."""
    return F.regexp_replace(ascii_lower(text), r"[^\p{L}\p{N}]", "")


def language_of(path: Column) -> Column:
    """The language that a path's extension belongs to, else null."""
    pairs = [x for ext, language in EXTENSIONS.items() for x in (F.lit(ext), F.lit(language))]
    return F.try_element_at(F.create_map(*pairs), F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def path_stem(path: Column) -> Column:
    """The last part after / or \\, without its extension unless the only dot begins it."""
    leaf = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.regexp_replace(leaf, r"^(.+)\.[^.]*$", "$1")


def parent_dir(path: Column) -> Column:
    """What is before the last slash; null for a top-level file."""
    return F.nullif(F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1), F.lit(""))


def ngrams(text: Column, n: int) -> Column:
    """Distinct windows of n characters; none if the text is shorter."""
    windows = F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda k: F.substring(text, k, F.lit(n)))
    return F.when(F.length(text) >= n, F.array_distinct(windows)).otherwise(F.array().cast("array<string>"))


def query_trigrams(query: Column) -> Column:
    """Distinct trigrams of the query's ASCII letters, digits and underscores."""
    return ngrams(F.regexp_replace(query, "[^A-Za-z0-9_]", ""), 3)


def shares_gram(path: Column, query: Column) -> Column:
    """Whether the path's stem shares a window of min(4, length) characters with the query; never for an empty query."""
    q, stem = alnum_lower(query), alnum_lower(path_stem(path))
    tests = F.lit(False)
    for n in (1, 2, 3, 4):
        of_size = (F.length(q) == n) if n < 4 else (F.length(q) >= 4)
        tests = tests | (of_size & F.arrays_overlap(ngrams(q, n), ngrams(stem, n)))
    return F.coalesce(tests, F.lit(False))


def is_qualified(query: Column) -> Column:
    """A separator (:: or #) with something on both sides of the last one."""
    return query.rlike(r"(?s)^.+(?:::|#).+$") & ~query.rlike(r"(?:::|#)$")


def query_leaf(query: Column) -> Column:
    return F.when(is_qualified(query), F.regexp_extract(query, r"(?s)^(.+)(?:::|#)(.+)$", 2)).otherwise(query)


def query_qualifier(query: Column) -> Column:
    return F.when(is_qualified(query), F.regexp_extract(query, r"(?s)^(.+)(?:::|#)(.+)$", 1))


def segments(scope: Column) -> Column:
    """Parts between :: and #, lowered (A-Z), empty ones dropped. Dots don't separate."""
    return F.filter(F.split(ascii_lower(scope), "::|#"), lambda s: s != "")


def parent_boost(qualifier: Column, parent: Column) -> Column:
    """120 + 60 for each part of the qualifier, at most 300, if those are the parent's last parts; else null."""
    return ends_with_segments(segments(qualifier), parent)


def ends_with_segments(q: Column, parent: Column) -> Column:
    """`parent_boost` for a qualifier that is cut into parts already."""
    p, n = segments(parent), F.size(q)
    tail = F.slice(p, F.greatest(F.size(p) - n + 1, F.lit(1)), F.greatest(n, F.lit(1)))
    fits = (n > 0) & (F.size(p) >= n) & (tail == q)
    return F.when(fits, F.least(F.lit(PARENT_BASE) + F.lit(PARENT_STEP) * n, F.lit(PARENT_CAP)))


def kind_bonus(kind: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, value in KIND_BONUS.items():
        out = F.when(kind == name, value).otherwise(out)
    return out


def has_wildcard(text: Column) -> Column:
    return text.rlike(r"[*?.]")


def strip_wildcards(text: Column) -> Column:
    return F.translate(text, "*?.", "")


def glob_regex(query: Column) -> Column:
    """An unanchored pattern: * any run, ? and . one character, letters and digits themselves, others ignored."""
    kept = F.regexp_replace(ascii_lower(query), r"[^\p{L}\p{N}*?.]", "")
    return F.regexp_replace(F.translate(kept, "?", "."), r"\*", ".*")


def under_any(path: Column, wanted: list[str]) -> Column:
    """Whether the path is one of those wanted or below it. A leading ./ and trailing / don't count; an empty one wants all."""
    out = F.lit(not wanted)
    for want in wanted:
        clean = want.removeprefix("./").rstrip("/")
        out = out | (F.lit(True) if clean in ("", ".") else (path == clean) | F.startswith(path, F.lit(f"{clean}/")))
    return out


def normalize_remote(url: Column) -> Column:
    """host/path of scheme://[user@]host[:port]/path or user@host:path, without .git; else null."""
    full = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/]*@)?([^/:@]+)(?::[0-9]*)?/+(.+)$"
    short = r"^(?:[^@/:\s]+@)([^/:@\s]+):/*(.+)$"
    clean = F.trim(url)
    pattern = F.when(F.contains(clean, F.lit("://")), F.lit(full)).otherwise(F.lit(short))
    host, path = F.regexp_extract(clean, full, 1), F.regexp_extract(clean, full, 2)
    host = F.when(F.contains(clean, F.lit("://")), host).otherwise(F.regexp_extract(clean, short, 1))
    path = F.when(F.contains(clean, F.lit("://")), path).otherwise(F.regexp_extract(clean, short, 2))
    path = F.regexp_replace(F.regexp_replace(path, r"/+$", ""), r"\.git$", "")
    return F.when(F.regexp_like(clean, pattern) & (host != "") & (path != ""), F.concat(host, F.lit("/"), path))


def identity_of(remote: Column, root: Column) -> Column:
    """The normalized remote, else local: and the path."""
    return F.coalesce(normalize_remote(remote), F.concat(F.lit("local:"), root))


def canonical_kind(token: Column) -> Column:
    """Short and alternative kind names; anything else passes, lowered."""
    low = ascii_lower(F.trim(token))
    pairs = [F.lit(x) for kv in KIND_ALIASES.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), low), low)


def canonical_langs(token: Column) -> Column:
    """The languages that a name, alias or beginning stands for; anything else passes, lowered."""
    low = ascii_lower(F.trim(token))
    names = F.array(*(F.lit(x) for x in LANGUAGES))
    pairs = [F.lit(x) for kv in LANGUAGE_ALIASES.items() for x in kv]
    alias = F.try_element_at(F.create_map(*pairs), low)
    begun = F.filter(names, lambda x: F.startswith(x, low))
    return F.when(alias.isNotNull(), F.array(alias)).when(F.size(begun) > 0, begun).otherwise(F.array(low))


def content_hash(text: Column) -> Column:
    """Equality only: 32 hexadecimal digits."""
    return F.md5(text.cast("binary"))


def signature(text: Column, line: Column) -> Column:
    """The trimmed source line, null if it is blank or past the end."""
    return F.nullif(F.trim(F.try_element_at(F.split(text, "\r?\n"), line.cast("int"))), F.lit(""))


def body_span(text: Column, line: Column, end_line: Column) -> Column:
    """Lines line to end_line, clamped to the text; null if the first is past the end."""
    lines = F.split(F.regexp_replace(text, r"\r?\n\z", ""), "\r?\n")
    last = F.least(F.coalesce(end_line, line), F.size(lines))
    span = F.slice(lines, line.cast("int"), F.greatest(last - line + 1, F.lit(1)).cast("int"))
    return F.when((line >= 1) & (line <= F.size(lines)), F.array_join(span, "\n"))
