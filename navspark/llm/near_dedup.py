"""Near-duplicate detection: SimHash fingerprints linked by pigeonring filtering.

Pigeonring (Qin and Xiao, 2018): cut two codes of ``bits`` bits into m segments in a ring. If they differ in
at most r bits, then from some segment on, for every k, the first k segments of the chain differ in at
most k*r/m bits together. With m = r + 1 that is floor(k*r/m) = k - 1: the first segment is equal, the first two
differ in one bit at most, the first three in two, and so on. The first two make the index key: each code is
stored under its own pair of segments, and looks up all pairs with at most one changed bit in the
second. Longer chains are checked one after the other before the full distance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navspark.llm.common import materialize, small_batches
from navspark.llm.components import components, keep_first, text_hash
from navspark.llm.fingerprints import fingerprint_batches

SHINGLE_WORDS = 4
MAX_DISTANCE = 4
#: Distinct codes of one index key that are compared in one task's memory; larger buckets are cut into pairs of blocks.
BUCKET = 2048


def segments(distance: int) -> list[tuple[int, int]]:
    """(shift, width) of the distance + 1 segments of a 64-bit code."""
    m = distance + 1
    widths = [64 // m + (k < 64 % m) for k in range(m)]
    return [(sum(widths[:k]), w) for k, w in enumerate(widths)]


def chain_masks(distance: int, start: int) -> list[tuple[np.uint64, int]]:
    """(mask of the first k segments from ``start``, most bits that may differ in them) for k = 1 to all."""
    parts = segments(distance)
    out, mask = [], 0
    for k in range(len(parts)):
        shift, width = parts[(start + k) % len(parts)]
        mask |= ((1 << width) - 1) << shift
        out.append((np.uint64(mask), (k + 1) * distance // len(parts)))
    return out


def index_batches(distance: int):
    """For ``mapInArrow``: (key, probe, fp) rows of each code: stored once, looked up once for each set bit of the second segment."""
    parts = segments(distance)
    m = len(parts)

    def run(batches):
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for start in range(m):
                (s1, w1), (s2, w2) = parts[start], parts[(start + 1) % m]
                first = (fps >> np.uint64(s1)) & np.uint64((1 << w1) - 1)
                second = (fps >> np.uint64(s2)) & np.uint64((1 << w2) - 1)
                for change in [0, *(1 << b for b in range(w2 if m > 1 else 0))]:
                    set_ = np.flatnonzero(second & np.uint64(change)) if change else np.arange(len(fps))
                    key = (first[set_] << np.uint64(w2)) | (second[set_] ^ np.uint64(change))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array((key * np.uint64(m) + np.uint64(start)).view(np.int64)),
                            pa.array(np.full(len(set_), change > 0)),
                            pa.array(fps[set_].view(np.int64)),
                        ],
                        ["key", "probe", "fp"],
                    )

    return run


def link_bucket(stored: np.ndarray, probes: np.ndarray, distance: int, start: int) -> list[tuple[int, int]]:
    """Links that join what is connected by pairs (stored, probe) that pass every chain budget: a forest, not all pairs."""
    codes = np.unique(np.concatenate([stored, probes]))
    s, p = np.searchsorted(codes, stored), np.searchsorted(codes, probes)
    differ = codes[p][:, None] ^ codes[s][None, :]
    near = None
    for mask, budget in chain_masks(distance, start)[2:] or chain_masks(distance, start):
        if near is None:
            near = np.bitwise_count(differ & mask) <= budget
            rows, cols = np.nonzero(near)
        else:
            good = np.bitwise_count(differ[rows, cols] & mask) <= budget
            rows, cols = rows[good], cols[good]
    a, b = p[rows], s[cols]
    good = a != b
    a, b = a[good], b[good]
    if not len(a):
        return []
    label = np.arange(len(codes))
    while True:  # every node takes the smallest label near it, until none changes
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            break
        label = low
    moved = np.flatnonzero(label != np.arange(len(codes)))
    return [(int(u), int(v)) for u, v in zip(codes[moved].view(np.int64), codes[label[moved]].view(np.int64), strict=True)]


def _whole_groups(batches, group_columns: int):
    """Chunks of rows sorted by group that end at the end of a group."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(columns[0]):
            continue
        change = np.zeros(len(columns[0]), bool)
        change[0] = True
        for c in columns[:group_columns]:
            change[1:] |= c[1:] != c[:-1]
        last = int(np.flatnonzero(change)[-1])
        same = bool(held) and all(held[-1][k][-1] == columns[k][0] for k in range(group_columns))
        if last == 0 and same:
            held.append(columns)
            continue
        yield [np.concatenate([h[k] for h in held] + [c[:last]]) for k, c in enumerate(columns)]
        held = [[c[last:] for c in columns]]
    if held:
        yield [np.concatenate([h[k] for h in held]) for k in range(len(held[0]))]


def _links_of(distance: int, group_columns: int):
    """For ``mapInArrow`` over rows sorted by group: links of each group. Groups hold a bounded number of rows."""
    m = distance + 1

    def run(batches):
        for columns in _whole_groups(batches, group_columns):
            n = len(columns[0])
            if n < 2:
                continue
            *group, probe, fps = columns
            fps = fps.view(np.uint64)
            change = np.zeros(n, bool)
            change[0] = True
            for c in group:
                change[1:] |= c[1:] != c[:-1]
            starts = np.flatnonzero(change)
            ends = np.append(starts[1:], n)
            stored = np.add.reduceat((~probe).astype(np.int64), starts)
            todo = (stored > 0) & (ends - starts > 1)
            u, v = [], []
            for x, y in zip(starts[todo].tolist(), ends[todo].tolist(), strict=True):
                p = probe[x:y]
                asked = fps[x:y] if group_columns == 1 else fps[x:y][p]  # in a whole bucket the stored codes ask too
                for a, b in link_bucket(fps[x:y][~p], asked, distance, int(group[0][x]) % m):
                    u.append(a)
                    v.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def link_codes(codes: DataFrame, distance: int, bucket: int = BUCKET) -> DataFrame:
    """(u, v) links of distinct 64-bit codes (column fp) whose components are those of all pairs at most ``distance`` bits apart.

    No list of all pairs is made: each index bucket gives a spanning forest of its near pairs. A bucket
    of more than ``bucket`` rows is dealt over pairs of blocks, each small enough for one task, so it
    is compared in full as well.
    """
    entries = codes.select("fp").mapInArrow(index_batches(distance), "key long, probe boolean, fp long")
    entries = materialize(entries, "pigeonring")
    large = entries.groupBy("key").count().filter(F.col("count") > bucket)
    large = materialize(large, "pigeonring-large")
    order = ["key", "probe", "fp"]
    if large.isEmpty():
        return entries.repartition("key").sortWithinPartitions(*order).mapInArrow(_links_of(distance, 1), "u long, v long")
    rest = entries.join(large, "key", "left_anti")
    links = rest.select(order).repartition("key").sortWithinPartitions(*order).mapInArrow(_links_of(distance, 1), "u long, v long")
    blocks = F.ceil(F.col("count") * 2 / F.lit(bucket)).cast("int")
    asking = entries.unionByName(entries.filter("NOT probe").withColumn("probe", F.lit(True)))
    dealt = asking.join(large, "key").withColumn("own", F.pmod(F.xxhash64("fp"), blocks).cast("int"))
    # the row is needed wherever its block is one of the two: stored rows by their block, probes by theirs
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).select(
        "key", F.when(F.col("probe"), F.col("own")).otherwise(F.col("other")).alias("x"), F.when(F.col("probe"), F.col("other")).otherwise(F.col("own")).alias("y"), "probe", "fp"
    )
    more = (
        dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "probe", "fp").mapInArrow(_links_of(distance, 3), "u long, v long")
    )
    return links.unionByName(more)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, text_hash, fp): one row per input row."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), text_hash(F.col(text_col)).alias("text_hash"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(fingerprint_batches(words), f"id {kind}, text_hash long, fp long")


def _grouped(docs: DataFrame, id_col: str, text_col: str, words: int, distance: int, bucket: int) -> tuple[DataFrame, DataFrame]:
    """((id, text_hash, fp) of each row; (fp, least, low) of each fingerprint: its smallest id and its component's smallest fingerprint)."""
    rows = materialize(fingerprints(docs, id_col, text_col, words), "fingerprints")
    codes = materialize(rows.groupBy("fp").agg(F.min("id").alias("least")), "codes")
    links = materialize(link_codes(codes, distance, bucket), "links")
    comps = components(links).select(F.col("u").alias("fp"), "low")
    return rows, codes.join(comps, "fp", "left").select("fp", "least", F.coalesce("low", "fp").alias("low"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, distance: int = MAX_DISTANCE, bucket: int = BUCKET
) -> DataFrame:
    """One row per input row: the id column, fp (the fingerprint as a signed long), component_id.

    Texts are lower-cased (A-Z), cut at ASCII white space and hashed by shingles of ``words`` words; rows whose
    fingerprints differ in ``distance`` bits or fewer are linked, and component_id is the smallest id that is
    reachable over links. Copies share a fingerprint and are compared once.

    Defined cases: null and blank texts have fingerprint zero and are linked like any other; null ids are
    never a component's smallest id unless it has no other; repeated rows stay repeated; an empty
    table gives no rows; other columns are ignored.
    """
    rows, labelled = _grouped(docs, id_col, text_col, words, distance, bucket)
    least = labelled.groupBy("low").agg(F.min("least").alias("component_id"))
    by_code = materialize(labelled.join(least, "low").select("fp", "component_id"), "code-components")
    return rows.join(by_code, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, distance: int = 8, bucket: int = BUCKET
) -> DataFrame:
    """One row of each group of near duplicates, that of the smallest id, columns unchanged.

    A null id is larger than every other. Of rows that repeat the smallest id the one with the smallest text hash stays, of rows
    equal in that too exactly one. An empty table gives no rows; columns of any other names pass through.
    """
    rows, labelled = _grouped(docs, id_col, text_col, words, distance, bucket)
    by_code = materialize(labelled.select("fp", F.col("low").alias("component")), "code-components")
    return keep_first(docs, rows.join(by_code, "fp"), id_col, text_col)
