"""Secrets as spans: fixed patterns, and strings in sensitive places that a primed compressor can't shorten.

A candidate is a key-like string with a sensitive word close before it. Its novelty is what it adds to the size of its surroundings,
compressed with zstandard, whose dictionary holds the identifiers that are most frequent in all texts: words, names and repeated values cost a few
bytes, random keys nearly as many as they have. Candidates that cost more than a share of their length are reported.
"""

from __future__ import annotations

import re

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navspark.llm.common import release, small_batches

#: In this order within a start. The first three have fixed patterns, the last is what the compressor finds.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 12, 18, 16
#: Words that make a place sensitive.
SENSITIVE = "password passwd passphrase pwd secret token apikey api_key api-key credential private auth authorization bearer session cookie signature salt pin access_key client_id".split()
#: A candidate's letters and length, and code points before it in which a sensitive word has to be.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{10,}")
NEAR_CHARS = 48
_NEAR = re.compile(rf"(?<![a-z])(?:{'|'.join(map(re.escape, SENSITIVE))})(?![a-z])", re.IGNORECASE | re.ASCII)
#: Code points on each side that a candidate is measured against, share of its bytes from which it is reported, zstandard's level.
SURROUNDING, NOVELTY, LEVEL = 512, 0.65, 9
#: Bytes of the identifier dictionary, and the identifiers that go into it.
DICTIONARY_BYTES = 1 << 15
IDENTIFIER = re.compile(r"(?<![A-Za-z0-9_])[A-Za-z_]{4,32}(?![A-Za-z0-9_])")
#: Different identifiers that a partition counts before it sends them on.
HELD = 100_000
SPAN = "struct<start:int,kind:int,end:int,bytes:int>"


def identifier_dictionary(docs: DataFrame, text_col: str = "text", size: int = DICTIONARY_BYTES) -> bytes:
    """The most frequent identifiers of all texts, ``size`` bytes at most, the most frequent one last, where zstandard finds it cheapest.

    Identifiers have no digits, so that keys that many copies of a text hold don't get in. Counts cover all texts; partitions add theirs up first.
    """

    def run(batches):
        counts: dict[str, int] = {}

        def sent():
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for match in IDENTIFIER.finditer(text or ""):
                    word = match[0]
                    counts[word] = counts.get(word, 0) + 1
                    if len(counts) >= HELD:
                        yield sent()
                        counts.clear()
        yield sent()
        release()

    small_batches(docs.sparkSession)
    counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    best = counted.orderBy(F.desc("n"), "word").limit(size // 5).collect()  # an identifier has four letters and a space at least
    taken, used = [], 0
    for row in best:
        if used + len(row.word) + 1 > size:
            break
        taken.append(row.word)
        used += len(row.word) + 1
    return " ".join(reversed(taken)).encode()


class Novelty:
    """Marginal compressed bytes of strings, against their surroundings and a dictionary."""

    def __init__(self, dictionary: bytes, level: int = LEVEL):
        primed = {"dict_data": zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)} if len(dictionary) >= 8 else {}
        self.packer = zstandard.ZstdCompressor(level=level, write_content_size=False, **primed)

    def __call__(self, text: str, start: int, end: int) -> int:
        """How many bytes longer the surroundings get by the string in the place where it stands; other places that hold it don't count."""
        value = text[start:end]
        before, after = (text[max(0, start - SURROUNDING) : start].replace(value, ""), text[end : end + SURROUNDING].replace(value, ""))
        around = [s.encode("utf-8", "surrogatepass") for s in (after + "\n" + before, value)]
        return len(self.packer.compress(around[0] + around[1])) - len(self.packer.compress(around[0]))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the fixed patterns find."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= ASSIGN_CHARS]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= HEX_CHARS]
    return sorted(out)


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty, share: float = NOVELTY) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, marginal bytes) of candidates that overlap no base span and cost more than ``share`` of their bytes. One sweep over both lists."""
    out, k, reach, near, at = [], 0, 0, [m.end() for m in _NEAR.finditer(text)], 0
    if not near:
        return out
    for match in CANDIDATE.finditer(text):
        start, end = match.span()
        while at < len(near) and near[at] <= start:
            at += 1
        while k < len(base) and base[k][0] < end:
            reach = max(reach, base[k][2])
            k += 1
        if reach > start or not at or near[at - 1] < start - NEAR_CHARS or not mixed(match[0]):
            continue
        cost = novelty(text, start, end)
        if cost > share * (end - start):
            out.append((start, len(KINDS) - 1, end, cost))
    return out


def mixed(value: str) -> bool:
    """Digits and letters, as keys have."""
    return any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


def find_secrets(docs: DataFrame, dictionary: bytes | None = None, share: float = NOVELTY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id column, spans, an array of (start, kind, end, bytes) by start and kind.

    Places are code points, ends exclusive; kind is the place in `KINDS`; bytes is the marginal compressed size of a span that the
    compressor added, null for spans of the fixed patterns. Without a dictionary `identifier_dictionary` of all rows is taken.

    Defined cases: null texts count as empty; ids are carried along whatever they are; rows that repeat get the same spans; an empty
    table gives no rows; texts of any length are read whole; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    primed = identifier_dictionary(docs, text_col) if dictionary is None else dictionary

    def run(batches):
        novelty = Novelty(primed)
        for batch in batches:
            found = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                every = [(*s, None) for s in base] + novel_spans(text or "", base, novelty, share)
                found.append([dict(zip(("start", "kind", "end", "bytes"), s, strict=True)) for s in sorted(every, key=lambda s: s[:3])])
            fields = pa.struct([(n, pa.int32()) for n in ("start", "kind", "end", "bytes")])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.list_(fields))], ["id", "spans"])
        release()

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, spans array<{SPAN}>").withColumnRenamed("id", id_col)


def secret_string(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
