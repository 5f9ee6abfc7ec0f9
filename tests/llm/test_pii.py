import hashlib
import random
import re

from navspark.llm import pii, queries

SF = "/root/testdata/sf0.01"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text):
    out = []
    for n, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind] if kind != "ip" else all(int(p) <= 255 for p in m[0].split("."))
            if good:
                out.append((m.start(), n, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


def digest(row_base):
    return hashlib.sha256(",".join(row_base).encode()).hexdigest()


def test_base_over_the_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op10_pii(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        want = base_spans(docs[r.doc_id])
        assert r.base_sha256 == digest(want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k in PATTERNS]
        assert set(want) <= set(filter(None, r.spans.split(",")))


ODD = [
    None, "", "a@b.c_d@e.f", "a@b.c@d.e", "x@a..b y@a.b. z@-.-", "é@b.co 🙂x@y.z", "a@b", "@a.b", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.1.1.01",
    "4111 1111 1111 1111", "4111  1111 1111 1111", "4111-1111-1111-1111x4111111111111111 ", "+1 (456) 555-2186 +12345678", "++1 2", "+1 23456789 + 3",
    "1" * 5000 + "@", "a.b" * 5000 + "@" + ".x" * 5000, "\x014111\x01111111111111 a\x01@b.c", "5 " * 4000, "+1" + " " * 5000, "a@b.c,d@e.f\n" * 300, "1.1.1.1 " * 300,
]


def test_odd_texts(spark):
    random.seed(6)
    texts = ODD + ["".join(random.choice("a1@.+- ()é4") for _ in range(random.randint(1, 60))) for _ in range(1500)]
    texts += ["".join(random.choice("0123456789 -.+") for _ in range(random.randint(10, 60))) for _ in range(1500)]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(None, "a@b.c", "y"), (0, "a@b.c", "y")], "doc_id long, text string, spans string")
    model = pii.SpanModel((-9.0,) * 6, {}, {})
    got = pii.find_pii(docs, model).select("doc_id", pii.span_string(pii.F.col("spans")).alias("s")).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        if r.doc_id:
            assert list(filter(None, r.s.split(","))) == base_spans(texts[r.doc_id]), texts[r.doc_id][:80]
    assert sorted(r.s for r in got if not r.doc_id) == ["", "email:0:5", "email:0:5"]


def test_empty_table(spark):
    assert pii.find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_em_finds_reliable_labelers_of_each_kind():
    random.seed(7)
    counts = {}
    right = {3: (0.97, 0.8, 0.75, 0.7, 0.5), 4: (0.6, 0.95, 0.8, 0.75, 0.5)}
    for _ in range(6000):
        kind, truth = random.choice((3, 4)), random.random() < 0.5
        votes = tuple(0 if random.random() < 0.2 else (1 if truth == (random.random() < r) else -1) for r in right[kind])
        features = (int(truth == (random.random() < 0.95)), random.randint(0, 4), 9, 0, 0, 1, 1)
        key = kind, votes, features
        counts[key] = counts.get(key, 0) + 1
    patterns = [(*key, n) for key, n in sorted(counts.items())]
    _, reliability = pii.em(patterns)
    for kind, rates in right.items():
        assert all(abs(reliability[kind, name] - r) < 0.08 for name, r in zip(pii.LABELERS, rates, strict=True))
    model = pii.train(patterns)
    assert model.probability(3, (1, 2, 9, 0, 0, 1, 1)) > 0.8 and model.probability(3, (0, 2, 9, 0, 0, 1, 1)) < 0.2


def test_added_spans_on_planted_documents(spark):
    """Precision and recall of what the classifier adds: keys and addresses in disguise, among digests, failing cards and order numbers."""
    random.seed(9)
    word = lambda: "".join(random.choice("abcdefghij") for _ in range(random.randint(2, 9)))
    run = lambda n, of="0123456789abcdef": "".join(random.choice(of) for _ in range(n))
    wanted = [
        lambda: f'token = "{run(40)}"', lambda: f"password={run(18)}", lambda: f"api_key: {run(32)}", lambda: f"{word()} (at) {word()} (dot) com", lambda: f"AKIA{run(16, '0123456789ABCDEFGH')}",
    ]
    decoys = [lambda: f"commit {run(40)}", lambda: f"order {run(16, '0123456789')}", lambda: "password: unforgettable", lambda: f"version 300.{run(2, '123')}.1.2", lambda: f"build {run(7)}"]
    plain = [lambda: f"{word()}.7@mail.example.com", lambda: "+1 (456) 555-2186", lambda: "4111 1111 1111 1111", lambda: f"8.{run(2, '123')}.4.4"]
    docs, planted = [], {}
    for n in range(900):
        parts, at = [], 0
        for make, keep in [(random.choice(wanted), True)] * (n % 3 == 0) + [(random.choice(decoys), False)] * (n % 3 == 1) + [(random.choice(plain), False)] * (n % 2):
            lead = " ".join(word() for _ in range(random.randint(1, 12))) + " "
            item = make()
            if keep:
                planted[n] = (at + len(lead), at + len(lead) + len(item))
            parts += [lead, item, " "]
            at += len(lead) + len(item) + 1
        docs.append((n, "".join(parts) + word()))
    rows = pii.find_pii(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    added = {(r.doc_id, s.start, s.end) for r in rows for s in r.spans if not s.base}
    right = added & {(n, *span) for n, span in planted.items()}
    wrong = [dict(docs)[n][x:y] for n, x, y in sorted(added - right)]
    assert len(right) >= 0.9 * len(planted) and len(right) >= 0.95 * len(added), (len(right), len(planted), wrong[:9])


def test_classifier_adds_spans_and_never_overlaps_base(spark):
    texts = ["password=b7db7aa4a5fcc78305 and mail a@b.com"] * 30 + ["nothing here 1234"] * 30 + ["call +1 (456) 555-2186"] * 10
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r.s for r in pii.find_pii(docs).select("doc_id", pii.span_string(pii.F.col("spans")).alias("s")).collect()}
    assert rows[0] == "secret:0:27,email:37:44"
    assert rows[30] == "" and rows[60] == "phone:5:22"
