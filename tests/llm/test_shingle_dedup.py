"""Near duplicates by five-word shingles against brute-force Jaccard similarity."""

import random

import numpy as np
from brute import find

import corpus_pipeline
from navspark.llm import shingle_dedup
from navspark.llm.common import table

SF = "/root/testdata/sf0.01"


def shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def leaders(docs):
    """Ids that stay: the smallest of each component of pairs whose similarity is 0.8 or more."""
    sets, parent, by_shingle = {d: shingles(t) for d, t in docs.items()}, {d: d for d in docs}, {}
    for d, s in sorted(sets.items()):
        shared = {}
        for x in s or [None]:
            for e in by_shingle.setdefault(x, []):
                shared[e] = shared.get(e, 0) + 1
            by_shingle[x].append(d)
        for e, n in shared.items():
            if not s or 5 * n >= 4 * (len(s) + len(sets[e]) - n):
                a, b = find(parent, d), find(parent, e)
                parent[max(a, b)] = min(a, b)
    return {d for d in docs if find(parent, d) == d}


def stays(spark, docs):
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    return {r.doc_id for r in corpus_pipeline.near_dedup(spark, rows, SF).collect()}


def test_pairs_about_the_bound(spark):
    random.seed(5)
    word = lambda: f"w{random.randint(0, 9999)}"
    docs = {}
    for _ in range(150):
        base = [word() for _ in range(random.randint(40, 120))]
        for _ in range(random.randint(2, 4)):
            copy = list(base)
            for _ in range(random.randint(0, 4)):
                copy[random.randrange(len(copy))] = word()
            docs[len(docs)] = " ".join(copy)
    docs |= {9001: None, 9002: "", 9003: " \n", 9004: "one two", 9005: "ONE two", 9006: "one", 9007: docs[0].upper()}
    assert stays(spark, docs) == leaders(docs)


def test_a_bucket_of_many_unlike_its_smallest(spark):
    random.seed(6)
    common = [f"c{k}" for k in range(60)]
    tails = [[f"t{g}x{k}" for k in range(30)] for g in range(8)]
    docs = {len(tails) * c + g: " ".join([*common, *t, f"end{c}"]) for g, t in enumerate(tails) for c in range(6)}
    assert stays(spark, docs) == leaders(docs)


def test_whole_table_against_all_pairs(spark):
    rows = table(spark, SF, "documents")
    docs = {r.doc_id: r.text for r in rows.collect()}
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, rows, SF).collect()} == leaders(docs)


def test_fingerprints_and_their_index_give_the_first_candidates(spark, monkeypatch):
    """Near dedup links SimHash fingerprints by the pigeonring index before anything else is compared."""
    asked, known = [], shingle_dedup.link_codes
    monkeypatch.setattr(shingle_dedup, "link_codes", lambda codes, distance: asked.append((codes.count(), distance)) or known(codes, distance))
    random.seed(7)
    base = [f"w{random.randint(0, 9999)}" for _ in range(300)]
    docs = {0: " ".join(base), 1: " ".join(base[:-1]), 2: " ".join(reversed(base)), 3: None}
    assert stays(spark, docs) == leaders(docs) == {0, 2, 3} and asked == [(4, 8)]
    sets = [shingle_dedup.shingle_set((t or "").encode(), 5) for t in docs.values()]
    codes = [(shingle_dedup.set_code(s), shingle_dedup.majority(s)) for s in sets]
    pairs = shingle_dedup.fingerprint_pairs(spark.createDataFrame([*codes, (5, codes[2][1])], "code long, fp long"), 8).collect()
    assert {(r.u, r.v) for r in pairs} == {tuple(sorted((codes[0][0], codes[1][0]))), tuple(sorted((5, codes[2][0])))}


def just_under(n):
    """Texts that share most shingles with each other, few of them enough."""
    random.seed(9)
    base = [f"c{k}" for k in range(100)]
    docs = {}
    for d in range(n):
        copy = list(base)
        for k in range(random.choice([2, 3, 4])):
            copy[random.randrange(100)] = f"e{d}x{k}"
        docs[d] = " ".join(copy)
    return docs


def test_a_group_about_the_bound_makes_no_list_of_pairs(spark, monkeypatch):
    docs, made, known = just_under(240), {}, shingle_dedup.materialize

    def counted(df, name, *rest):
        out = known(df, name, *rest)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(shingle_dedup, "materialize", counted)
    assert stays(spark, docs) == leaders(docs)
    assert max(made.values()) <= 25 * len(docs), made


def test_large_buckets_are_compared_in_full(spark):
    docs = just_under(120)
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in shingle_dedup.drop_similar(rows, bucket=8).collect()} == leaders(docs)


def test_links_of_a_bucket_join_what_pairs_join():
    random.seed(3)
    for _ in range(300):
        sets = [np.array(sorted(random.sample(range(14), random.randint(1, 12))), np.uint64) for _ in range(random.randint(2, 12))]
        labels, sides = (np.array([random.randint(0, 9) for _ in sets]) for _ in range(2))
        sides %= random.choice([1, 2])
        out = shingle_dedup.links_among(sets, labels, sides, 0.6)
        across = sides.min() != sides.max()
        pairs = [(i, j) for j in range(len(sets)) for i in range(j) if (not across or sides[i] != sides[j]) and shingle_dedup.similar(sets[i], sets[j], 0.6)]
        assert all(p in pairs for p in out)
        roots = []
        for links in (pairs, out):
            parent = {("n", k): ("n", k) for k in range(len(sets))} | {("l", int(x)): ("l", int(x)) for x in labels}
            for a, b in [(("n", i), ("n", j)) for i, j in links] + [(("n", k), ("l", int(x))) for k, x in enumerate(labels)]:
                a, b = find(parent, a), find(parent, b)
                parent[max(a, b)] = min(a, b)
            roots.append([find(parent, ("n", k)) for k in range(len(sets))])
        assert roots[0] == roots[1]
