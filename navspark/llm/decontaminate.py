"""Benchmark decontamination by template windows.

Words become a template: numbers, units and names are replaced by typed placeholders, all other words are
lower-cased and stripped of marks. Windows of WINDOW words are taken in three forms: names told by their place, every capitalised
word a name, and the values themselves. The windows of the benchmark are a table; documents are scanned once for windows that
may be in it (a bit table tells), those are joined to it by hash, and each pair of text and item is checked along the
diagonals so found: runs of equal words or slots are taken together, and their longest part that follows one one-to-one
renaming counts if it is long enough. A question with other numbers or names in it is therefore caught like a verbatim one. Items
shorter than a window have to be there verbatim and whole.

Copies of one text are checked once. Nothing of the benchmark but the bit table, whose size is bounded, is sent to tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navspark.llm.common import bit_filter, fresh, hash128, materialize, maybe_in, release, small_batches

WINDOW = 8
#: Words that a match must cover, or the whole item if that is shorter; the part of them that must be literal words where slots have changed.
MIN_WORDS, MIN_LITERAL = 13, 0.5
#: Bits of the table that documents' windows are tested with: 64 for each window of the benchmark, as powers of two within these.
LEAST_BITS, MOST_BITS = 20, 27
#: Bytes of text that are cut into words at once.
SLICE_BYTES = 400_000
#: Items that one text is checked against at once; more are dealt to several rows.
SHARE_ITEMS = 64

#: Words that name units of measurement or money, and words for numbers, in English, German, French and Spanish. Articles that
#: are numbers as well (ein, un, una) are left out.
UNITS = frozenset(
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons ml l liter liters litre litres gallon gallons cup cups "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "kmh mph celsius fahrenheit degrees degree percent % dollar dollars cent cents euro euros usd eur gbp "
    "gramm kilogramm pfund tonne tonnen sekunde sekunden minuten stunde stunden tag tage tagen woche wochen monat monate monaten jahr jahre jahren grad prozent "
    "mètre mètres kilomètre kilomètres gramme grammes kilogramme kilogrammes seconde secondes heure heures jour jours semaine semaines mois ans année années degré degrés "
    "metro metros kilómetro kilómetros gramo gramos kilogramo kilogramos litro litros segundo segundos minuto minutos hora horas día días semana semanas mes meses año años grado grados".split()
)
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half twice "
    "null eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn "
    "zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend millionen "
    "deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt vingts trente quarante cinquante soixante mille "
    "cero uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciséis diecisiete dieciocho diecinueve "
    "veinte veintiuno veintidós veintitrés veinticuatro veinticinco veintiséis veintisiete veintiocho veintinueve "
    "treinta cuarenta cincuenta sesenta setenta ochenta noventa cien ciento doscientos trescientos mil millones".split()
)
#: Numbers of several words: with hyphens (twenty-one, vingt-et-un), and German ones in one word (zweiundzwanzig, dreihundert).
_ONE = f"(?:{'|'.join(sorted(NUMBER_WORDS))})"
_SEVERAL = f"^(?:{_ONE}(?:-(?:et-)?(?:un|{_ONE}))+|(?:ein|{_ONE})(?:hundert|tausend|und{_ONE})+)$"
_NUMBER = r"[$€£+-]?\d[\d.,:/]*"
_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "$%+-") + "“”‘’«»…–—¿¡"
NUM, UNIT, NAME = 1, 2, 3
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Tables of a tabulation hash: a random number for each byte at each of the first places of a word.
_PLACES = 48
_TABLE = np.random.default_rng(7).integers(0, 1 << 64, (_PLACES, 256), np.uint64)


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string, over all of them at once; XXH64 for those of more than `_PLACES` bytes."""
    sizes = np.asarray(pc.binary_length(words), np.int64)
    long = np.flatnonzero(sizes > _PLACES)
    data = np.frombuffer(b"".join(pc.if_else(pc.greater(pc.binary_length(words), _PLACES), "", words).cast(pa.binary()).to_pylist()), np.uint8)
    sizes = np.where(sizes > _PLACES, 0, sizes)
    begin = np.cumsum(sizes) - sizes
    each = _TABLE[np.arange(len(data)) - np.repeat(begin, sizes), data]
    out = np.full(len(words), np.uint64(_NOTHING))
    some = np.flatnonzero(sizes)
    if len(some):
        out[some] = np.bitwise_xor.reduceat(each, begin[some]) ^ (sizes[some].astype(np.uint64) * _STEP)
    for n in long.tolist():
        out[n] = xxhash.xxh64_intdigest(words[n].as_py().encode())
    return out


@dataclass
class Canon:
    """What a template needs of distinct raw words: the value (stripped of marks, lower-cased) and its hash, the placeholder type or 0,
    whether the word may be a name, and whether a sentence ends with it."""

    value: pa.Array
    plain: np.ndarray
    kind: np.ndarray
    titled: np.ndarray
    ends: np.ndarray


def canonical(raw: pa.Array) -> Canon:
    """Names are told by their place: see `templates`."""
    bare = pc.utf8_trim(raw, characters=_MARKS)
    lower = pc.utf8_lower(bare)
    number = _flags(pc.match_substring_regex(lower, f"^{_NUMBER}(?:st|nd|rd|th|%)?$")) | _flags(pc.is_in(lower, _NUMBERS)) | _flags(pc.match_substring_regex(lower, _SEVERAL))
    unit = _flags(pc.is_in(lower, _UNITS)) & ~number
    measure = np.flatnonzero(_flags(pc.match_substring_regex(lower, f"^{_NUMBER}[a-z%]+$")) & ~number & ~unit)
    number[measure[_flags(pc.is_in(pc.replace_substring_regex(lower.take(pa.array(measure)), f"^{_NUMBER}", ""), _UNITS))]] = True
    kind = np.where(number, NUM, np.where(unit, UNIT, 0)).astype(np.int8)
    titled = _flags(pc.match_substring_regex(bare, r"^\p{Lu}[^\p{Lu}]*\p{Ll}[^\p{Lu}]*$")) & (kind == 0)
    return Canon(lower, word_hashes(lower), kind, titled, _flags(pc.match_substring_regex(raw, "[.!?:][\"')”’»]*$")))


def _flags(found: pa.Array) -> np.ndarray:
    return np.array(found.to_numpy(zero_copy_only=False), bool)


_UNITS, _NUMBERS = pa.array(sorted(UNITS)), pa.array(sorted(NUMBER_WORDS))
#: The hash of a word that is only marks.
_NOTHING = xxhash.xxh64_intdigest(b"")


@dataclass
class Template:
    """Texts as template, one after the other. Per word: the code and placeholder type with names told by place, the same with every
    capitalised word as a name, a hash of the value, and the place of the value itself in ``value``; begin: where each text begins, and the end."""

    code: np.ndarray
    kind: np.ndarray
    named: np.ndarray
    named_kind: np.ndarray
    plain: np.ndarray
    number: np.ndarray
    value: pa.Array
    begin: np.ndarray

    def values(self, at: np.ndarray) -> list[str]:
        return self.value.take(pa.array(self.number[at])).to_pylist()

    def forms(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """The codes that windows are taken of, each with which words are neither placeholders nor mere marks."""
        word = self.plain != np.uint64(_NOTHING)
        return [(self.code, word & (self.kind == 0)), (self.named, word & (self.named_kind == 0))]


def templates(texts: pa.Array) -> Template:
    """A capitalised word is a name unless it begins a text or a sentence, where it may be either. Null counts as empty."""
    split = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    raw = split.flatten()
    real = np.asarray(pc.binary_length(raw)) > 0
    begin = np.concatenate([[0], np.cumsum(real)])[np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(split)))])]
    coded = raw.filter(pa.array(real)).dictionary_encode()
    words = canonical(coded.dictionary)
    number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    kind, titled, plain = words.kind[number], words.titled[number], words.plain[number]
    code = np.where(kind > 0, kind.astype(np.uint64), plain)
    named, named_kind = np.where(titled, np.uint64(NAME), code), np.where(titled, NAME, kind)
    begins = np.zeros(len(number) + 1, bool)
    begins[1:] = words.ends[number]
    begins[begin] = True
    name = titled & ~begins[:-1]
    return Template(np.where(name, np.uint64(NAME), code), np.where(name, NAME, kind), named, named_kind, plain, number, words.value, begin)


def window_hashes(code: np.ndarray, size: int = WINDOW) -> np.ndarray:
    if len(code) < size:
        return np.zeros(0, np.uint64)
    n = len(code) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = out * _STEP + code[k : k + n]
    return out ^ (out >> np.uint64(29))


def _of_form(code: np.ndarray, word: np.ndarray, inside: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of the windows within one text that hold ``least`` words."""
    many = np.concatenate([[0], np.cumsum(word)])
    at = np.flatnonzero(inside & (many[WINDOW:] - many[:-WINDOW] >= least))
    return window_hashes(code)[at], at


def windows(t: Template, short: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of all windows: of WINDOW words in each form, and of the sizes ``short`` of values.

    Placeholder windows with fewer than two words that are no slots are left out: a match with changed slots has half of its words unchanged at
    least, so it has another window; one without changed slots has windows of values, of which only those of mere marks go.
    """
    found = []
    end = np.repeat(t.begin[1:], np.diff(t.begin))
    place = np.arange(len(t.number))
    if len(t.number) >= WINDOW:
        inside = (place + WINDOW <= end)[: len(t.number) - WINDOW + 1]
        found += [_of_form(code, word, inside, 2) for code, word in t.forms()]
        found.append(_of_form(t.plain, t.plain != np.uint64(_NOTHING), inside, 1))
    for size in short:
        if len(t.number) >= size:
            at = np.flatnonzero((place + size <= end)[: len(t.number) - size + 1])
            found.append((window_hashes(t.plain, size)[at], at))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _item_windows(batches):
    """For ``mapInArrow`` over (number, text) of items: (hash, number, place, size); an item shorter than a window is one window."""
    for batch in batches:
        t = templates(batch.column("text"))
        sizes = np.diff(t.begin)
        hashes, places = windows(t, [])
        item = np.searchsorted(t.begin, places, "right") - 1
        place, size = places - t.begin[item], np.full(len(item), WINDOW)
        for n in np.flatnonzero((sizes > 0) & (sizes < WINDOW)).tolist():
            hashes = np.append(hashes, window_hashes(t.plain[t.begin[n] : t.begin[n + 1]], int(sizes[n])))
            item, place, size = np.append(item, n), np.append(place, 0), np.append(size, sizes[n])
        number = batch.column("number").take(pa.array(item))
        yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), number, pa.array(place), pa.array(size)], ["hash", "number", "place", "size"])


def _probes(hashes, log: int):
    """Two bits of a table of 2**log for each hash."""
    return hashes >> np.uint64(64 - log), hashes >> np.uint64(8) & np.uint64((1 << log) - 1)


def _bit_table(table: DataFrame, log: int) -> np.ndarray:
    """The bit table of a column hash, in bytes: built by Spark, 16 MB at most."""
    probes = F.array(F.shiftrightunsigned("hash", 64 - log), F.shiftrightunsigned("hash", 8).bitwiseAND(F.lit((1 << log) - 1)))
    bits = table.select(F.explode(probes).alias("bit")).select((F.col("bit") + 1).alias("bit"))
    parts = bits.groupBy(F.bitmap_bucket_number("bit").alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = np.zeros(1 << log - 3, np.uint8)
    for r in parts.toLocalIterator():
        part = np.frombuffer(r.bits, np.uint8)[: len(out)]
        out[(r.n - 1) * 4096 :][: len(part)] = part
    return out


def _slices(batches):
    """The batches, cut to rows of about `SLICE_BYTES` of text: what is worked out of a text is many times its size."""
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0), np.int64))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")))
            yield batch.slice(at, end - at)
            at = end


def _scan(bits, log: int, short: list[int]):
    """For ``mapInArrow`` over (id, text): (id, text, hashes, places) of texts with windows that may be in the benchmark."""

    def run(batches):
        table = bits.value
        for batch in _slices(batches):
            t = templates(batch.column("text"))
            hashes, places = windows(t, short)
            first, second = _probes(hashes, log)
            hit = np.flatnonzero(table[first >> np.uint64(3)] >> (first & np.uint64(7)).astype(np.uint8) & 1)
            second = second[hit]
            hit = hit[(table[second >> np.uint64(3)] >> (second & np.uint64(7)).astype(np.uint8) & 1) > 0]
            hashes, places = hashes[hit], places[hit]
            doc = np.searchsorted(t.begin[1:], places, "right")
            order = np.argsort(doc, kind="stable")
            docs, begin = np.unique(doc[order], return_index=True)
            offsets = pa.array(np.append(begin, len(order)), pa.int32())
            rows = pa.array(docs)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).take(rows) for c in ("id", "text")),
                    pa.ListArray.from_arrays(offsets, pa.array(hashes[order].view(np.int64))),
                    pa.ListArray.from_arrays(offsets, pa.array((places - t.begin[doc])[order])),
                ],
                ["id", "text", "hashes", "places"],
            )
        release()

    return run


class Renaming:
    """A one-to-one renaming of slots that pairs are added to and taken from; it tells whether any two contradict each other."""

    def __init__(self):
        self.pairs: dict[tuple, int] = {}
        self.there: dict[tuple, int] = {}
        self.back: dict[tuple, int] = {}
        self.changed = self.clashes = 0

    def add(self, kind: int, a: str, b: str, by: int = 1) -> None:
        pair, old = (kind, a, b), self.pairs.get((kind, a, b), 0)
        self.pairs[pair] = old + by
        if bool(old) == bool(old + by):
            return
        self.changed += by * (a != b)
        for side, key in ((self.there, (kind, a)), (self.back, (kind, b))):
            n = side.get(key, 0)
            side[key] = n + by
            self.clashes += max(n + by - 1, 0) - max(n - 1, 0)


def _longest(slots: list[tuple[int, str, str] | None], literal: list[bool], whole: int) -> tuple[int, int, int] | None:
    """(words covered, first, slots changed) of the longest part of paired words that counts: its slots follow one renaming.

    Items shorter than a window have to be there in full without a change."""
    need, best = min(MIN_WORDS, whole), None
    for verbatim in (False, True):
        renaming, low, words = Renaming(), 0, 0
        for k, slot in enumerate(slots):
            words += literal[k]
            if slot:
                renaming.add(*slot)
            while renaming.clashes or (verbatim and renaming.changed):
                words -= literal[low]
                if slots[low]:
                    renaming.add(*slots[low], by=-1)
                low += 1
            covered = k + 1 - low
            if covered < need or (best and covered <= best[0]):
                continue
            if not renaming.changed or (whole >= WINDOW and words >= MIN_LITERAL * covered):
                best = covered, low, renaming.changed
    return best


def match_item(text: Template, item: Template, diagonals: list[int]) -> tuple[int, int, int, int] | None:
    """(item's words, words covered, first word in the text, slots changed) of the longest good match, None without one.

    Words pair along a diagonal if their values are equal or both are placeholders of one type. Runs of WINDOW
    pairs or more of one diagonal are taken together. Both templates are of one text."""
    whole, size, best = len(item.number), len(text.number), None
    for diagonal in sorted(diagonals):
        begin, end = max(diagonal, 0), min(diagonal + whole, size)
        here, there = slice(begin, end), slice(begin - diagonal, end - diagonal)
        kind, item_kind = text.named_kind[here], item.named_kind[there]
        equal = text.plain[here] == item.plain[there]
        pairs = equal | ((kind == item_kind) & (kind > 0))
        edges = np.flatnonzero(np.diff(np.concatenate([[0], pairs.astype(np.int8), [0]])))
        runs = [np.arange(x, y) for x, y in edges.reshape(-1, 2).tolist() if y - x >= min(WINDOW, whole)]
        if not runs:
            continue
        at = np.concatenate(runs)
        values, asked = text.values(begin + at), item.values(begin - diagonal + at)
        kinds = np.where(item_kind > 0, item_kind, kind)[at].tolist()
        slots = [(k, a, v) if k else None for k, a, v in zip(kinds, asked, values, strict=True)]
        # a name that is the same in both tells as much as a word; in German every noun looks like one
        literal = (equal & ((item_kind == 0) | (item_kind == NAME)))[at].tolist()
        good = _longest(slots, literal, whole)
        if good and (best is None or good[0] > best[1]):
            best = whole, good[0], begin + int(at[good[1]]), good[2]
    return best


_FOUND = "k1 long, k2 long, number long, item_words long, matched_words long, first_word long, changed_slots long"


def _check(batches):
    """For ``mapInArrow`` over (k1, k2, text, asked), asked being (number, text, diagonals) of items: the matches."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            text = templates(pa.array([row["text"]], pa.string()))
            for a in row["asked"]:
                found = match_item(text, templates(pa.array([a["text"]], pa.string())), a["diagonals"])
                if found:
                    out.append((row["k1"], row["k2"], a["number"], *found))
        columns = list(zip(*out, strict=True)) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [c.split()[0] for c in _FOUND.split(", ")])
    release()


def _find(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, k1, k2 of rows with a window that may be in the benchmark; matches of each such text; number and item of the benchmark)."""
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.monotonically_increasing_id().alias("number"), F.col(item_col).alias("item"), F.col(item_text).cast("string").alias("text"))
    items = materialize(items.filter("text IS NOT NULL"), "benchmark-items")
    table = materialize(items.select("number", "text").mapInArrow(_item_windows, "hash long, number long, place long, size long"), "benchmark-windows")
    log = min(MOST_BITS, max(LEAST_BITS, (64 * table.count()).bit_length()))
    short = sorted(r.size for r in table.filter(F.col("size") < WINDOW).select("size").distinct().collect())  # fewer than WINDOW rows
    bits = spark.sparkContext.broadcast(_bit_table(table, log))
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    hits = slim.mapInArrow(_scan(bits, log, short), f"id {kind}, text string, hashes array<long>, places array<long>")
    k1, k2 = hash128(F.col("text"))
    hits = materialize(hits.select("id", k1.alias("k1"), k2.alias("k2"), "text", "hashes", "places"), "window-hits")
    texts = materialize(hits.drop("id").dropDuplicates(["k1", "k2"]), "window-texts")
    at = texts.select("k1", "k2", F.explode(F.arrays_zip("hashes", "places")).alias("w")).select("k1", "k2", F.col("w.hashes").alias("hash"), F.col("w.places").alias("at"))
    pairs = at.join(table, "hash").groupBy("k1", "k2", "number").agg(F.collect_set(F.col("at") - F.col("place")).alias("diagonals"))
    pairs = materialize(pairs, "window-pairs")
    shares = pairs.groupBy("k1", "k2").agg(F.ceil(F.count(F.lit(1)) / F.lit(SHARE_ITEMS)).cast("int").alias("shares"))
    asked = pairs.join(shares, ["k1", "k2"]).withColumn("share", F.pmod(F.xxhash64("number"), F.col("shares"))).join(items.select("number", F.col("text").alias("item_text")), "number")
    asked = asked.groupBy("k1", "k2", "share").agg(F.collect_list(F.struct("number", F.col("item_text").alias("text"), "diagonals")).alias("asked"))
    found = texts.select("k1", "k2", "text").join(asked, ["k1", "k2"]).select("k1", "k2", "text", "asked").mapInArrow(_check, _FOUND)
    return hits.select("id", "k1", "k2"), materialize(found, "contaminated"), items.select("number", "item")


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """One row per document and benchmark item that it holds: the id column, item_id, item_words, matched_words, first_word, changed_slots.

    changed_slots counts numbers, names and units that differ from the item's: 0 is a verbatim passage. Documents are
    scanned once; only texts that hold a window of the benchmark are shuffled.

    Defined cases: null and blank texts match nothing, on either side; items of fewer than `WINDOW` words match verbatim and
    whole only, so a benchmark item of one word is found wherever that word stands; null ids
    are carried along; repeated rows are reported each; empty tables give no rows; other columns are ignored.
    """
    rows, found, items = _find(docs, benchmark, id_col, text_col, item_col, item_text)
    return rows.join(found, ["k1", "k2"]).join(items, "number").select(
        F.col("id").alias(id_col), F.col("item").alias("item_id"), "item_words", "matched_words", "first_word", "changed_slots"
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, columns unchanged.

    Rows are told by the hash of their text, so ids are not needed and rows that repeat go or stay together. Only rows whose hash may be that
    of a contaminated text (a bit table of bounded size tells) take part in a join; all others stay where they are.

    Defined cases: null and blank texts stay; null or repeated ids and columns of any name pass through; an empty table gives no rows.
    """
    slim = docs.select(F.lit(None).cast("int").alias("id"), F.col(text_col).alias("text"))
    _, found, _ = _find(slim, benchmark, "id", "text", item_col, item_text)
    gone = materialize(found.select("k1", "k2").distinct(), "contaminated-texts")
    k1, k2, maybe = fresh(docs, "k1_", "k2_", "maybe_")
    a, b = hash128(F.col(text_col).cast("string"))
    keyed = maybe_in(docs.withColumn(k1, a).withColumn(k2, b), [k1, k2], bit_filter(gone, ["k1", "k2"]), maybe)
    checked = keyed.filter(maybe).join(gone.select(F.col("k1").alias(k1), F.col("k2").alias(k2)), [k1, k2], "left_anti")
    return keyed.filter(~F.col(maybe)).unionByName(checked).select(docs.columns)
