"""Personal data as spans: fixed patterns, and a span classifier trained by weak supervision.

Candidates are what the fixed patterns find and what wider ones propose. Labelers vote on each: a
strict check, a gazetteer, its context, its shape, its borders. Expectation-maximisation over the table of vote
patterns estimates how reliable each labeler is for each kind, and a logistic span classifier over features of the span and its
surroundings is trained on the resulting probabilities. Spans of the fixed patterns always stay; the classifier adds others.

Only built-in Spark functions work on rows. The driver sees counts by votes and features alone: a table whose
size is bounded by how many combinations of those there are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from navspark.llm.common import fresh, materialize

#: In this order within a start. The first four have fixed patterns.
KINDS = ("email", "ip", "card", "phone", "secret", "name")
BASE_KINDS = 4
LABELERS = ("strict", "gazetteer", "context", "shape", "border")
#: What the span classifier sees, each as a small whole number: see `_features`.
FEATURES = ("valid", "length", "digits", "letters", "head", "prev", "next")
#: Code points before a span that the context labeler reads; probability from which the classifier adds a span.
CONTEXT_CHARS, ADD_FROM = 40, 0.8
#: Weight of the votes of all kinds, in candidates, where a kind has few of its own.
SHARED = 5.0
ROUNDS = 60
#: Stands for a separator that is valid where it stands, so that patterns need no repeated groups, on which Java's matcher recurses.
JOIN = "\x01"

EMAIL_DOT = r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])"
EMAIL = rf"(?:\G|(?<![A-Za-z0-9._%+\-{JOIN}]))[A-Za-z0-9._%+\-{JOIN}]++@[A-Za-z0-9-]++{JOIN}[A-Za-z0-9\-{JOIN}]++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
IP_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
IP_VALID = rf"^{IP_PART}\.{IP_PART}\.{IP_PART}\.{IP_PART}$"
CARD_JOIN = r"(?<=[0-9])[\x20-](?=[0-9])"
#: Runs of 12 digits or more: shorter ones are dropped in any case.
CARD = rf"(?<![0-9{JOIN}])(?=(?:[0-9]{JOIN}?){{12}})[0-9{JOIN}]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
NATIONAL = r"(?<![0-9+.(-])\(?[2-9][0-9]{2}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
HIDDEN_EMAIL = r"(?i)(?<![A-Za-z0-9._-])[a-z0-9._-]++\x20?[(\[]at[)\]]\x20?[a-z0-9-]{1,63}\x20?[(\[]dot[)\]]\x20?[a-z]{2,24}"
SECRET = r"(?i)(?<![a-z0-9_])(?:password|passwd|pwd|secret|token|api[_-]?key)(?![a-z0-9_])\x20{0,3}[=:]\x20{0,3}\"?[A-Za-z0-9+/_-]{8,}+\"?|(?-i:(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9]))"
TITLED = r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20[A-Z][a-z]{1,30}(?:\x20[A-Z][a-z]{1,30})?"

#: Words that the gazetteer and context labelers know.
FIRST_NAMES = "james mary john patricia robert jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah charles karen".split()
TOP_DOMAINS = "com org net edu gov io info de fr es uk eu us".split()
CUES = {
    0: "mail email e-mail contact write",
    1: "ip server host address client",
    2: "card visa mastercard credit debit payment",
    3: "phone tel call fax mobile cell",
    4: "password token secret key login credential",
    5: "name dear signed by",
}
COUNTER_CUES = "order invoice isbn version serial ticket article page section build commit checksum sha md5 hash revision"
#: A run that looks random: letters and digits, as keys and digests have.
RANDOM = r"(?<![A-Za-z0-9_/+.=:\"-])(?=[A-Za-z0-9]*[0-9])(?=[A-Za-z0-9]*[A-Za-z])[A-Za-z0-9]{24,}+(?![A-Za-z0-9_/+-])"
#: Lengths that are summed up in one array.
RUN = 128
SPAN = "struct<start:int,kind:int,end:int,value:string,before:string,after:string>"


def _once(value: Column, use) -> Column:
    """What ``use`` makes of a value that is worked out once: inside a lambda an expression would be worked out for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _starts(lengths: Column) -> Column:
    """The sum of the lengths before each place. Runs of `RUN` are summed by themselves and then moved on, as an array that grows is copied each time."""
    empty = F.from_json(F.lit('{"at":0,"out":[]}'), "struct<at:int,out:array<int>>")
    add = lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))

    def summed(x):
        numbers = F.sequence(F.lit(0), F.floor((F.size(x) - 1) / RUN).cast("int"))
        return F.transform(numbers, lambda k: F.aggregate(F.slice(x, k * RUN + 1, F.lit(RUN)), empty, add))

    def moved(runs):
        before = F.aggregate(F.transform(runs, lambda r: r["at"]), empty, add)["out"]
        return F.flatten(F.zip_with(runs, before, lambda r, at: F.transform(r["out"], lambda x: x + at)))

    whole = _once(lengths, lambda x: F.when(F.size(x) > 0, _once(summed(x), moved)))
    return F.coalesce(whole, F.array().cast("array<int>"))


def _spans(text: Column, pattern: str, kind: int, keep) -> Column:
    """All leftmost non-overlapping matches as `SPAN`, in order, those that ``keep`` holds for.

    The gaps and the matches of one pattern alternate, so their lengths give the places, and gaps their surroundings.
    """
    found = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("values"))

    def paired(f):
        n = F.size(f["values"])
        pairs = F.zip_with(F.slice(f["gaps"], F.lit(1), n), f["values"], lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
        return F.zip_with(pairs, F.slice(f["gaps"], F.lit(2), n), lambda p, g: F.struct(p["gap"].alias("gap"), p["value"].alias("value"), g.alias("after")))

    def place(pair, at):
        start = at + F.length(pair["gap"])
        end = start + F.length(pair["value"])
        before, after = F.right(pair["gap"], F.lit(CONTEXT_CHARS)), F.left(pair["after"], F.lit(CONTEXT_CHARS))
        return F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), pair["value"].alias("value"), before.alias("before"), after.alias("after"))

    def placed(pairs):
        return F.zip_with(pairs, _starts(F.transform(pairs, lambda p: F.length(p["gap"]) + F.length(p["value"]))), place)

    return F.filter(_once(_once(found, paired), placed), lambda s: keep(s["value"]))


def _none() -> Column:
    return F.from_json(F.lit("[]"), f"array<{SPAN}>")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    places = F.sequence(F.lit(1), F.length(digits))

    def add(total, k):
        d = F.substring(F.reverse(digits), k, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(k % 2 == 0, twice).otherwise(d)

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def _between(value: Column, low: int, high: int) -> Column:
    n = F.length(_digits(value))
    return (n >= low) & (n <= high)


def _any(value: Column) -> Column:
    return F.lit(True)


def _candidates(text: Column) -> list[tuple[Column, Column]]:
    """(test that is cheap and must hold for there to be any, spans) of each pattern; the first four are the fixed ones, unchecked values included."""
    plain = F.translate(text, JOIN, "\x02")
    email_text = F.regexp_replace(plain, EMAIL_DOT, JOIN)
    card_text = F.regexp_replace(plain, CARD_JOIN, JOIN)
    digits = text.rlike(r"[0-9]{3}")
    return [
        (F.contains(text, F.lit("@")), _spans(email_text, EMAIL, 0, _any)),
        (text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), _spans(plain, IP, 1, _any)),
        (text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), _spans(card_text, CARD, 2, lambda v: _between(v, 12, 19))),
        (F.contains(text, F.lit("+")), _spans(plain, PHONE, 3, _any)),
        (digits, _spans(plain, NATIONAL, 3, _any)),
        (text.rlike(r"(?i)[(\[]at[)\]]"), _spans(plain, HIDDEN_EMAIL, 0, _any)),
        (text.rlike(r"(?i)passw|pwd|secret|token|api[_-]?key|AKIA"), _spans(plain, SECRET, 4, _any)),
        (text.rlike(r"(?:Mr|Mrs|Ms|Dr|Prof)\.? [A-Z]"), _spans(plain, TITLED, 5, _any)),
        (text.rlike(r"[A-Za-z0-9]{24}"), _spans(plain, RANDOM, 4, _any)),
    ]


def _is_base(pattern: int, value: Column) -> Column:
    """Whether a value of the pattern-th candidate list passes the fixed pattern's check."""
    checks = {0: _any, 1: lambda v: v.rlike(IP_VALID), 2: lambda v: _luhn(_digits(v)), 3: lambda v: _between(v, 9, 15)}
    return checks[pattern](value) if pattern in checks else F.lit(False)


def _vote(plus: Column, minus: Column | None = None) -> Column:
    vote = F.when(plus, 1)
    return (vote.when(minus, -1) if minus is not None else vote).otherwise(0)


def _words(words: list[str]) -> str:
    return rf"(?i)(?<![a-z])(?:{'|'.join(words)})(?![a-z])"


def _class(token: Column) -> Column:
    """Kind of a neighbouring token: 0 none, 1 a word, 2 a number, 3 marks or a mixture."""
    return F.when(token == "", 0).when(token.rlike(r"^[\p{L}'’-]+[.,;:!?]?$"), 1).when(token.rlike(r"^[(+]?[0-9]"), 2).otherwise(3)


def _features(s: Column, valid: Column, cue: Column) -> list[Column]:
    """`FEATURES` of a span: its check, length class, tenths of digits, letter cases, first character, and what is beside it (4 and 5: a cue for or against)."""
    value = s["value"]
    n = F.length(value)
    length = F.when(n < 8, 0).when(n < 16, 1).when(n < 24, 2).when(n < 48, 3).otherwise(4)
    digits = F.floor(F.length(_digits(value)) * 10 / n).cast("int")
    low, up = value.rlike("[a-z]"), value.rlike("[A-Z]")
    letters = low.cast("int") + up.cast("int") * 2
    head = F.when(value.rlike("^[0-9]"), 0).when(value.rlike("^[A-Za-z]"), 1).otherwise(2)
    prev = F.when(cue > 0, 4).when(cue < 0, 5).otherwise(_class(F.regexp_extract(s["before"], r"(\S*)\s*$", 1)))
    return [c.alias(f) for c, f in zip((valid, length, digits, letters, head, prev, _class(F.regexp_extract(s["after"], r"^\s*(\S*)", 1))), FEATURES, strict=True)]


def _judged(pattern: int, spans: Column) -> Column:
    """The spans with the labelers' votes, the classifier's features and whether they are base spans."""
    kind = (0, 1, 2, 3, 3, 0, 4, 5, 4)[pattern]

    def judge(s):
        value = s["value"]
        base, digits = _is_base(pattern, value), _digits(value)
        if pattern < BASE_KINDS:
            strict = _vote(base, F.lit(True))
        elif kind == 4:
            strict = _vote(value.rlike(r"(?:[=:].*[0-9]|^AKIA)") & value.rlike(r"[A-Za-z0-9+/_-]{16}"), F.lit(True))
        else:
            strict = F.lit(0)
        if kind == 0:
            gazetteer = _vote(value.rlike(rf"(?i)[.{JOIN}\x20)\]](?:{'|'.join(TOP_DOMAINS)})$"))
            shape = _vote(value.rlike(r"^[^@]*[A-Za-z]"), F.lit(True))
        elif kind == 1:
            gazetteer = _vote(~value.rlike(r"^0*(?:0|10|127|255|192\.168|2[4-9][0-9])\."), F.lit(True))
            shape = _vote(~value.rlike(r"(?:^|\.)0[0-9]"), F.lit(True))
        elif kind == 2:
            gazetteer = _vote(digits.rlike(r"^(?:3[47]|4|5[1-5]|6011)"), F.lit(True))
            shape = _vote(digits.rlike(r"^[0-9]{15,16}$"), digits.rlike(r"^([0-9])\1*$"))
        elif kind == 3:
            gazetteer = _vote(value.rlike(r"^\+?[0-9\x20]{0,3}\(?[2-9][0-9]{2}\)?[\x20.-]"), F.lit(True))
            shape = _vote(value.rlike(r"[\x20.)-][0-9]{2,4}[\x20.-][0-9]{2,4}$"), digits.rlike(r"^([0-9])\1*$"))
        elif kind == 4:
            public = value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$") | ~value.rlike("[0-9]")  # bare digests, and words
            gazetteer = _vote(value.rlike(r"(?i)^(?:passw|pwd|token|AKIA|secret|api)") & ~public, public)
            shape = _vote(value.rlike(r"(?:[0-9][A-Za-z+/_-]|[A-Za-z+/_-][0-9])[^=:]*?(?:[0-9][A-Za-z+/_-]|[A-Za-z+/_-][0-9])"), F.lit(True))
        else:
            gazetteer = _vote(value.rlike(_words(FIRST_NAMES)))
            shape = _vote(value.rlike(r"[A-Z][a-z]+$"))
        cue = _vote(s["before"].rlike(_words(CUES[kind].split())), s["before"].rlike(_words(COUNTER_CUES.split())))
        beside = _class(F.regexp_extract(s["before"], r"(\S*)\s*$", 1))
        context = F.when(cue != 0, cue).otherwise(_vote(beside <= 1, beside == 2))
        around = F.concat(F.right(s["before"], F.lit(1)), F.left(s["after"], F.lit(1)))
        border = _vote(~around.rlike(r"[A-Za-z0-9_]"), F.lit(True))
        votes = [v.alias(n) for v, n in zip((strict, gazetteer, context, shape, border), LABELERS, strict=True)]
        return F.struct(s["start"], s["kind"], s["end"], base.alias("base"), *votes, *_features(s, strict, cue))

    return F.transform(spans, judge)


#: (kind, votes, features, count): all that the models are trained on.
Pattern = tuple[int, tuple[int, ...], tuple[int, ...], int]


@dataclass(frozen=True)
class SpanModel:
    """Weights of the span classifier: one for each kind, one for each feature's value in a kind; what it has not seen counts 0.

    reliability: by kind and labeler, the chance that a vote other than 0 is right."""

    kinds: tuple[float, ...]
    weights: dict[tuple[int, str, int], float]
    reliability: dict[tuple[int, str], float]

    def probability(self, kind: int, features: tuple[int, ...]) -> float:
        z = self.kinds[kind] + sum(self.weights.get((kind, n, v), 0.0) for n, v in zip(FEATURES, features, strict=True))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))

    def logit(self, span: Column) -> Column:
        """As one look-up for each feature in a table of the weights."""
        z = F.element_at(F.array(*(F.lit(w) for w in self.kinds)), span["kind"] + 1)
        if self.weights:
            table = F.create_map(*(x for (k, n, v), w in sorted(self.weights.items()) for x in (F.lit(f"{k}{n}{v}"), F.lit(w))))
            for name in FEATURES:
                key = F.concat(span["kind"].cast("string"), F.lit(name), span[name].cast("string"))
                z = z + F.coalesce(F.try_element_at(table, key), F.lit(0.0))
        return z


def em(patterns: list[Pattern], rounds: int = ROUNDS) -> tuple[list[float], dict[tuple[int, str], float]]:
    """(probability of each pattern being personal data, reliability by kind and labeler) by expectation-maximisation.

    Votes are independent given the truth, each labeler with its own chance of each vote in each class and kind; a kind has its
    own prior. The votes of all kinds together weigh as much as `SHARED` candidates in each kind.
    """
    believed = [0.5 + 0.45 * max(-1.0, min(1.0, sum(v) / 3)) for _, v, _, _ in patterns]
    kinds = sorted({k for k, *_ in patterns})
    reliability: dict[tuple[int, str], float] = {}
    votes_of = (-1, 0, 1)
    for _ in range(rounds):
        table = {(k, n, c, v): 0.0 for k in (-1, *kinds) for n in range(len(LABELERS)) for c in (0, 1) for v in votes_of}
        prior = {k: [1.0, 1.0] for k in kinds}
        for p, (kind, votes, _, count) in zip(believed, patterns, strict=True):
            for c, share in ((1, p * count), (0, (1 - p) * count)):
                prior[kind][c] += share
                for n, v in enumerate(votes):
                    table[kind, n, c, v] += share
                    table[-1, n, c, v] += share
        chance = {}
        for k in kinds:
            for n, name in enumerate(LABELERS):
                for c in (0, 1):
                    every = sum(table[-1, n, c, v] for v in votes_of) + 3
                    smooth = {v: table[k, n, c, v] + SHARED * (table[-1, n, c, v] + 1) / every for v in votes_of}
                    for v in votes_of:
                        chance[k, n, c, v] = smooth[v] / sum(smooth.values())
                right = table[k, n, 1, 1] + table[k, n, 0, -1] + 1
                reliability[k, name] = right / (right + table[k, n, 1, -1] + table[k, n, 0, 1] + 1)
        believed = []
        for kind, votes, _, _ in patterns:
            score = [math.log(prior[kind][c]) + sum(math.log(chance[kind, n, c, v]) for n, v in enumerate(votes)) for c in (0, 1)]
            believed.append(1 / (1 + math.exp(max(-40.0, min(40.0, score[0] - score[1])))))
    return believed, reliability


def train(patterns: list[Pattern], steps: int = 400) -> SpanModel:
    """The span classifier: logistic regression of the probabilities that `em` gives on kinds and their features."""
    believed, reliability = em(patterns)
    merged: dict[tuple, list[float]] = {}
    for p, (kind, _, features, count) in zip(believed, patterns, strict=True):
        held = merged.setdefault((kind, features), [0.0, 0.0])
        held[0] += p * count
        held[1] += count
    keys = sorted({(k, n, v) for k, f in merged for n, v in zip(FEATURES, f, strict=True)})
    place = {key: len(KINDS) + n for n, key in enumerate(keys)}
    rows = np.array([[k, *(place[k, n, v] for n, v in zip(FEATURES, f, strict=True))] for k, f in merged], np.int64).reshape(-1, len(FEATURES) + 1)
    share = np.array([a / b for a, b in merged.values()])
    mass = np.sqrt([b for _, b in merged.values()])
    weight = np.zeros(len(KINDS) + len(keys))
    for _ in range(steps):
        z = weight[rows].sum(axis=1)
        slope = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - share) * mass / max(mass.sum(), 1.0)
        weight -= np.bincount(rows.ravel(), np.repeat(slope, rows.shape[1]), len(weight)) + 0.0005 * weight
    return SpanModel(tuple(weight[: len(KINDS)].tolist()), dict(zip(keys, weight[len(KINDS) :].tolist(), strict=True)), reliability)


def find_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id column, found, and a number of the row, last): the candidates of each text with votes, written to scratch space, without the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    staged = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    lists = [F.when(test, spans).otherwise(_none()).alias(f"c{n}") for n, (test, spans) in enumerate(_candidates(F.col("text")))]
    staged = staged.select("id", "text", *lists)
    judged = [F.when(F.size(f"c{n}") > 0, _judged(n, F.col(f"c{n}"))) for n in range(len(lists))]
    numbers = ",".join(f"{n}:int" for n in (*LABELERS, *FEATURES))
    none = F.array().cast(f"array<struct<start:int,kind:int,end:int,base:boolean,{numbers}>>")
    found = F.concat(*(F.coalesce(j, none) for j in judged))
    number = fresh(docs.select(id_col), "row")[0]
    return materialize(staged.select(F.col("id").alias(id_col), found.alias("found"), F.monotonically_increasing_id().alias(number)), "pii")


def count_patterns(candidates: DataFrame) -> list[Pattern]:
    """Counts over all candidates by kind, votes and features; as many rows at most as there are combinations."""
    columns = [F.col(f"s.{n}").alias(n) for n in ("kind", *LABELERS, *FEATURES)]
    rows = candidates.select(F.explode("found").alias("s")).groupBy(*columns).count().collect()
    return sorted((r.kind, tuple(r[n] for n in LABELERS), tuple(r[n] for n in FEATURES), r["count"]) for r in rows)


def find_pii(docs: DataFrame, model: SpanModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id column, spans, an array of (start, kind, end, base) by start and kind.

    Places are code points, ends exclusive; kind is the place in `KINDS`. Spans of the fixed patterns have
    base set; the others are those that the classifier adds and that no base span overlaps. Without a
    model one is trained on the candidates of all rows.

    Defined cases: null texts count as empty; ids are carried along whatever they are; repeated rows get the same
    spans; an empty table gives no rows; texts of any length are read whole; other columns are ignored.
    """
    candidates = find_candidates(docs, id_col, text_col)
    model = model or train(count_patterns(candidates))
    row = candidates.columns[-1]
    limit = math.log(ADD_FROM / (1 - ADD_FROM))
    shape = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["base"].alias("base"))
    base = F.transform(F.filter("found", lambda s: s["base"]), shape)
    likely = F.transform(F.filter("found", lambda s: ~s["base"] & (model.logit(s) >= limit)), shape)
    staged = candidates.select(F.col(id_col).alias("id"), F.col(row).alias("row"), base.alias("base"), likely.alias("likely"))
    added = free_spans(staged.filter(F.size("likely") > 0).select("row", F.explode(F.concat("base", "likely")).alias("s")))
    every = F.concat("base", F.coalesce("added", F.array().cast(staged.schema["base"].dataType)))
    return staged.drop("likely").join(added, "row", "left").select(F.col("id").alias(id_col), F.array_sort(every).alias("spans"))


def free_spans(spans: DataFrame) -> DataFrame:
    """(row, added) from (row, s): the spans that are no base span, overlap none, and overlap none that begins before them or with them and ends after them.

    A sweep over each row's places in order of beginning, then of end, the widest first: what was passed reaches as far as its largest end.
    """
    places = spans.groupBy("row", F.col("s.start").alias("start"), F.col("s.end").alias("end")).agg(
        F.max("s.base").alias("is_base"), F.array_sort(F.collect_set(F.when(~F.col("s.base"), F.col("s.kind")))).alias("kinds")
    )
    order = Window.partitionBy("row").orderBy("start", F.desc("end"))
    passed, ahead = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    of_base = F.col("is_base")
    swept = places.withColumns(
        {
            "reach": F.max(F.when(of_base | (F.size("kinds") > 0), F.col("end"))).over(passed),
            "next": F.min(F.when(of_base, F.col("start"))).over(ahead),
        }
    )
    clear = ~of_base & (F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.coalesce("next", F.col("end")) >= F.col("end"))
    kinds = swept.filter(clear).select("row", "start", "end", F.explode("kinds").alias("kind"))
    span = F.struct("start", "kind", "end", F.lit(False).alias("base"))
    return kinds.groupBy("row").agg(F.collect_list(span).alias("added"))  # of one text


def span_string(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )
