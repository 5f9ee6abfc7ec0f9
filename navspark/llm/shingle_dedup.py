"""Near-duplicate removal by SimHash fingerprints and the Jaccard similarity of word shingles, confirmed exactly.

Round one: each distinct set of shingles gets a SimHash fingerprint, and the pigeonring index of `near_dedup` links those at most DISTANCE
bits apart. Its links and sets of one fingerprint are compared, set with set, and what is confirmed is joined to components.

At a similarity of 0.8 some 10 of 64 bits differ, so no distance that an index can look up reaches all such pairs. Round two is for those: each
set has BANDS keys of ROWS minimum hashes, and sets of different components that share a key are compared. Of a pair of similarity s a share of
1 - (1 - s^ROWS)^BANDS share one: all but 1 in 20,000 at 0.8, fewer are missed above. Nothing below the bound is linked.

No list of pairs is made. A bucket whose sets lie in several components gets the sets themselves, is compared where it lies and gives only links
that join components. A large one is dealt over pairs of blocks and so compared in full as well.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navspark.llm.common import binary_texts, bit_filter, materialize, maybe_in, release, small_batches
from navspark.llm.components import components, keep_first, text_hash
from navspark.llm.fingerprints import majority, shingle_hashes
from navspark.llm.near_dedup import _whole_groups, link_codes

SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: Bits in which fingerprints that the index links may differ.
DISTANCE = 8
BANDS, ROWS = 25, 5
#: Sets of one bucket that are compared in one task's memory; larger buckets are cut into pairs of blocks.
BUCKET = 512
#: Shingles whose minimum hashes are taken at once.
_BLOCK = 1 << 12
_RANDOM = np.random.default_rng(42)
_FACTORS = _RANDOM.integers(0, 1 << 31, (BANDS * ROWS, 1), np.uint32) * np.uint32(2) + np.uint32(1)
_OFFSETS = _RANDOM.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The distinct hashes of a text's shingles in ascending order."""
    return np.unique(shingle_hashes(text, words))


def set_code(hashes: np.ndarray) -> int:
    """A signed 64-bit hash of the whole set: sets that are equal share it."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), 7)).view(np.int64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The BANDS bucket keys of a set; none of an empty one, which is like no other."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), _BLOCK):
        low = np.minimum(low, (short[at : at + _BLOCK] * _FACTORS + _OFFSETS).min(axis=1))
    low = low.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = (key ^ low[:, k]) * _STEP
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two ascending sets have a Jaccard similarity of ``similarity`` or more."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def _code_batches(words: int):
    """For ``mapInArrow`` over (id, text_hash, text): (id, text_hash, code, fp, keys)."""

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t, words) for t in binary_texts(batch.column("text"))]
            codes, fps = pa.array([set_code(s) for s in sets], pa.int64()), pa.array([majority(s) for s in sets], pa.int64())
            keys = pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_hash"), codes, fps, keys], ["id", "text_hash", "code", "fp", "keys"])
        release()

    return run


def _set_batches(words: int):
    """For ``mapInArrow`` over (text): (code, hashes)."""

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t, words) for t in binary_texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array([set_code(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["code", "hashes"])
        release()

    return run


def _starts(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))


def _open_rows(batches):
    """For ``mapInArrow`` over (key, low, code) sorted so: the rows of buckets that hold several components, with their number."""
    for keys, lows, codes in _whole_groups(batches, 1):
        if len(keys):
            starts = _starts(keys)
            count = np.diff(np.append(starts, len(keys)))
            several = np.repeat(lows[starts] != lows[starts + count - 1], count)
            columns = [c[several] for c in (keys, lows, codes, np.repeat(count, count))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["key", "low", "code", "n"])


def links_among(sets: list[np.ndarray], labels: np.ndarray, sides: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Places (i, j) of similar sets that join what has different labels: enough to connect all such pairs.

    If ``sides`` differ, only sets of different sides are compared: those of one side are in another group's care.
    """
    label, out = np.unique(labels, return_inverse=True)[1], []
    size = np.array([len(s) for s in sets])
    ends = np.cumsum(size)
    # for each shingle the sets that hold it
    _, words = np.unique(np.concatenate(sets), return_inverse=True)
    holders = np.repeat(np.arange(len(sets)), size)[np.argsort(words, kind="stable")]
    held = np.bincount(words)
    first = np.cumsum(held) - held
    across = sides.min() != sides.max()
    for k in range(len(sets) - 1):
        asked = (label != label[k]) & (np.arange(len(sets)) > k)
        asked &= (np.minimum(size, size[k]) >= similarity * np.maximum(size, size[k]) - 1e-9) & ((sides != sides[k]) | (not across))
        if not asked.any():
            continue
        own = words[ends[k] - size[k] : ends[k]]
        n = held[own]
        at = np.repeat(first[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(holders[at], minlength=len(sets))
        for j in np.flatnonzero(asked & (both >= similarity * (size + size[k] - both) - 1e-9)).tolist():
            if label[j] != label[k]:
                out.append((k, j))
                label[label == label[j]] = label[k]
    return out


def _link_batches(similarity: float):
    """For ``mapInArrow`` over (key, x, y, own, low, code, hashes) sorted by the first three: links of each bucket or pair of blocks."""

    def linked(group):
        sets = [np.frombuffer(h, np.uint64) for h in group["hashes"]]
        codes = group["code"]
        pairs = links_among(sets, np.array(group["low"]), np.array(group["own"]), similarity)
        return pa.RecordBatch.from_arrays([pa.array([f(codes[i], codes[j]) for i, j in pairs], pa.int64()) for f in (min, max)], ["u", "v"])

    def run(batches):
        group, now = None, None
        for batch in batches:
            rows = batch.to_pydict()
            for at, *row in zip(zip(rows["key"], rows["x"], rows["y"], strict=True), *(rows[c] for c in ("own", "low", "code", "hashes")), strict=True):
                if at != now:
                    if group:
                        yield linked(group)
                    group, now = {c: [] for c in ("own", "low", "code", "hashes")}, at
                for held, value in zip(group.values(), row, strict=True):
                    held.append(value)
        if group:
            yield linked(group)
        release()

    return run


def _confirm_batches(similarity: float):
    """For ``mapInArrow`` over (u, v, a, b): the pairs whose sets are similar."""

    def run(batches):
        for batch in batches:
            sets = zip(binary_texts(batch.column("a")), binary_texts(batch.column("b")), strict=True)
            good = [similar(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), similarity) for a, b in sets]
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    return run


def _sets_of(texts: DataFrame, needed: DataFrame, codes: DataFrame, words: int) -> DataFrame:
    """(code, hashes) of the needed codes, once each. Texts that are not needed go first, by a bit table of hashes of one text of each code; the join is exact."""
    marks = materialize(codes.join(needed, "code", "left_semi").select("text_hash"), "shingle-texts")
    kept = maybe_in(texts, ["text_hash"], bit_filter(marks, ["text_hash"]), "needed").filter("needed").select("text")
    # a text whose set is equal is a copy of it, so any one stands for all
    sets = kept.mapInArrow(_set_batches(words), "code long, hashes binary").join(needed, "code", "left_semi").dropDuplicates(["code"])
    return materialize(sets, "shingle-sets")


def _confirmed(texts: DataFrame, pairs: DataFrame, codes: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (u, v) of codes that are similar."""
    needed = materialize(pairs.select(F.explode(F.array("u", "v")).alias("code")).distinct(), "shingle-needed")
    sets = _sets_of(texts, needed, codes, words)
    held = pairs.join(sets.select(F.col("code").alias("u"), F.col("hashes").alias("a")), "u").join(sets.select(F.col("code").alias("v"), F.col("hashes").alias("b")), "v")
    return materialize(held.select("u", "v", "a", "b").mapInArrow(_confirm_batches(similarity), "u long, v long"), "shingle-links")


def fingerprint_pairs(codes: DataFrame, distance: int) -> DataFrame:
    """(u, v) codes: the links of their fingerprints, each with the smallest code of a fingerprint, and that with the others of its fingerprint."""
    hubs = materialize(codes.groupBy("fp").agg(F.min("code").alias("hub")), "fingerprints")
    links = materialize(link_codes(hubs, distance).distinct(), "links")
    apart = links.join(hubs.select(F.col("fp").alias("u"), F.col("hub").alias("a")), "u").join(hubs.select(F.col("fp").alias("v"), F.col("hub").alias("b")), "v")
    same = codes.join(hubs, "fp").filter("code <> hub").select(F.col("hub").alias("a"), F.col("code").alias("b"))
    pairs = apart.select("a", "b").unionByName(same)
    return pairs.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def _bucket_links(texts: DataFrame, entries: DataFrame, comps: DataFrame, codes: DataFrame, words: int, similarity: float, bucket: int) -> DataFrame:
    """(u, v) codes of similar sets that share a key and lie in different components: enough to join all such pairs."""
    labelled = entries.join(comps, "code", "left").select("key", F.coalesce("low", "code").alias("low"), "code")
    rows = labelled.repartition("key").sortWithinPartitions("key", "low", "code").mapInArrow(_open_rows, "key long, low long, code long, n long")
    rows = materialize(rows, "open-buckets")
    sets = _sets_of(texts, materialize(rows.select("code").distinct(), "shingle-needed"), codes, words)
    blocks = F.when(F.col("n") > bucket, F.ceil(F.col("n") * 2 / F.lit(bucket))).otherwise(1).cast("int")
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("code"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    # a set is needed wherever its block is one of the two
    dealt = dealt.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "low", "code").join(sets, "code")
    order = ["key", "x", "y"]
    dealt = dealt.select(*order, "own", "low", "code", "hashes").repartition(*order).sortWithinPartitions(*order)
    return materialize(dealt.mapInArrow(_link_batches(similarity), "u long, v long").distinct(), "shingle-links")


def _grouped(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float, distance: int, bucket: int) -> tuple[DataFrame, DataFrame]:
    """((id, text_hash, code) of each row; (code, least, low) of each set: its smallest id and its component's smallest code)."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), text_hash(F.col(text_col)).alias("text_hash"), F.col(text_col).cast("string").alias("text"))
    rows = materialize(slim.mapInArrow(_code_batches(words), f"id {kind}, text_hash long, code long, fp long, keys array<long>"), "shingle-codes")
    codes = materialize(rows.groupBy("code").agg(F.min("id").alias("least"), F.min("text_hash").alias("text_hash"), F.min("fp").alias("fp")), "codes")
    entries = materialize(rows.select(F.explode("keys").alias("key"), "code").distinct(), "bands")
    texts = slim.select("text_hash", "text")
    links = _confirmed(texts, materialize(fingerprint_pairs(codes, distance), "shingle-pairs"), codes, words, similarity)
    comps = components(links).select(F.col("u").alias("code"), "low")
    more = _bucket_links(texts, entries, comps, codes, words, similarity, bucket)
    if not more.isEmpty():
        comps = components(links.unionByName(more)).select(F.col("u").alias("code"), "low")
    return rows.select("id", "text_hash", "code"), codes.join(comps, "code", "left").select("code", "least", F.coalesce("low", "code").alias("low"))


def similar_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, similarity: float = SIMILARITY, distance: int = DISTANCE, bucket: int = BUCKET
) -> DataFrame:
    """One row per input row: the id column and component_id, the smallest id reachable over links of ``similarity`` or more.

    Texts are lower-cased (A-Z) and cut at ASCII white space; a text of ``words`` words or fewer is one shingle.

    Defined cases: null and blank texts are copies of each other and like nothing else; null ids are never a component's
    smallest id unless it has no other; repeated rows stay repeated; an empty table gives no rows; other columns are ignored.
    """
    rows, labelled = _grouped(docs, id_col, text_col, words, similarity, distance, bucket)
    least = labelled.groupBy("low").agg(F.min("least").alias("component_id"))
    by_code = materialize(labelled.join(least, "low").select("code", "component_id"), "code-components")
    return rows.join(by_code, "code").select(F.col("id").alias(id_col), "component_id")


def drop_similar(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, similarity: float = SIMILARITY, distance: int = DISTANCE, bucket: int = BUCKET
) -> DataFrame:
    """One row of each group of near duplicates, that of the smallest id, columns unchanged.

    A null id is larger than every other. Of rows that repeat the smallest id the one with the smallest text hash stays, of rows
    equal in that too exactly one. An empty table gives no rows; columns of any other names pass through.
    """
    rows, labelled = _grouped(docs, id_col, text_col, words, similarity, distance, bucket)
    by_code = materialize(labelled.select("code", F.col("low").alias("component")), "code-components")
    return keep_first(docs, rows.join(by_code, "code"), id_col, text_col)
