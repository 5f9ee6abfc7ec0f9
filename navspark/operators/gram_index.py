"""The inverted index of names and paths that recall reads: postings in sorted segments, with tombstones.

A posting is a gram with the symbol that holds it. Grams are marked by what they are: `<` a name's beginning of up to three letters, `~` three letters
anywhere in it, `/` up to three of a type's path. A segment also has tombstones, rows without a gram: they say that what older segments
hold of a file is void. A pass over a repository adds one segment with the postings of the files that changed; a level that is full is merged into
one segment of the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navspark.functions.textcols import ascii_lower, ngrams, query_trigrams
from navspark.schemas import PATH_RECALL_KINDS
from navspark.store import CatalogStore, Transaction

#: Letters of a beginning or a path window, and segments that a level holds before they are merged.
HEAD, FULL = 3, 4
BEGIN, ANYWHERE, PATH = "<", "~", "/"
#: Level of segments that `bulk` writes.
BULK = 30


def _marked(mark: str, grams: Column) -> Column:
    return F.transform(grams, lambda g: F.concat(F.lit(mark), g))


def postings(symbols: DataFrame) -> DataFrame:
    """(repository_id, gram, text, id, file_id) of symbols. text is what the gram is the beginning or a window of, where recall has to compare more than the gram."""
    name, none = F.col("name_lower"), F.array().cast("array<string>")
    low = F.when(F.col("kind").isin(*PATH_RECALL_KINDS), ascii_lower(F.col("file")))
    sizes = F.sequence(F.lit(1), F.least(F.length(name), F.lit(HEAD)))
    heads = F.when(F.length(name) > 0, F.transform(sizes, lambda n: F.substring(name, F.lit(1), n))).otherwise(none)
    windows = F.concat(*(F.coalesce(ngrams(low, n), none) for n in range(1, HEAD + 1)))
    grams = F.concat(_marked(BEGIN, heads), _marked(ANYWHERE, ngrams(name, HEAD)), _marked(PATH, windows))
    file_id = F.col("file_id") if "file_id" in symbols.columns else F.xxhash64("repository_id", "file")
    rows = symbols.select("repository_id", F.explode(grams).alias("gram"), name.alias("name"), low.alias("low"), "id", file_id.alias("file_id"))
    longest = F.startswith("gram", F.lit(BEGIN)) & (F.length("gram") == HEAD + 1)
    text = F.when(longest, F.col("name")).when(F.startswith("gram", F.lit(PATH)), F.col("low"))
    return rows.select("repository_id", "gram", text.alias("text"), "id", "file_id")


def strong_grams(key: Column) -> Column:
    """The gram that names beginning with the key have."""
    return F.array(F.concat(F.lit(BEGIN), F.substring(key, 1, HEAD)))


def broad_grams(key: Column) -> Column:
    """Grams of which names or paths that the broad layers look for have at least one."""
    first = F.array(F.concat(F.lit(BEGIN), F.substring(key, 1, 1)), F.concat(F.lit(PATH), F.substring(key, 1, HEAD)))
    return F.concat(first, _marked(ANYWHERE, query_trigrams(key)))


# ---- segments


def label(level: int, seq: int) -> str:
    return f"L{level}-{seq:08d}-"


def place(folder: str) -> tuple[int, int]:
    """(level, number) of a segment, from its folder's name. One that was written in bulk, with those of other repositories, is the oldest."""
    name = folder.rpartition("/")[2]
    if not name.startswith("L"):
        return BULK, 0
    level, seq, _ = name.split("-")
    return int(level[1:]), int(seq)


def alive(segments: DataFrame) -> DataFrame:
    """The postings that no later segment has voided, without tombstones."""
    dead = segments.filter("gram IS NULL").groupBy("file_id").agg(F.max("seq").alias("_dead"))
    rows = segments.filter("gram IS NOT NULL").join(dead, "file_id", "left")
    return rows.filter("_dead IS NULL OR seq >= _dead").drop("_dead")


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file_id, fresh, dead) of files whose content differs between two states: fresh ones get postings, dead ones a tombstone. Both: id, content_hash."""
    before = old.select(F.col("id").alias("file_id"), F.col("content_hash").alias("_before"), F.lit(True).alias("dead"))
    after = new.select(F.col("id").alias("file_id"), F.col("content_hash").alias("_after"), F.lit(True).alias("fresh"))
    both = before.join(after, "file_id", "full").filter("NOT _before <=> _after OR dead IS NULL OR fresh IS NULL")
    return both.select("file_id", F.coalesce("fresh", F.lit(False)).alias("fresh"), F.coalesce("dead", F.lit(False)).alias("dead"))


def add_segment(tx: Transaction, repository_id: int, symbols: DataFrame, changes: DataFrame) -> int:
    """Stages a segment for the files in ``changes`` and merges the levels that are full then. How many files it covers."""
    changes = changes.cache()
    n_fresh, n_dead = changes.agg(F.count_if("fresh"), F.count_if("dead")).first()
    if n_fresh + n_dead:
        held = tx.base.folders("grams", repository_id)
        seq = 1 + max((place(f)[1] for f in held), default=0)
        fresh = postings(symbols.join(changes.filter("fresh"), "file_id", "left_semi"))
        none = F.lit(None)
        dead = changes.filter("dead").select(F.lit(repository_id).alias("repository_id"), none.alias("gram"), none.alias("text"), none.alias("id"), "file_id")
        rows = (fresh.unionByName(dead) if held else fresh).withColumn("seq", F.lit(seq))
        tx.replace("grams", merged(tx, [*held, tx.stage("grams", rows, label(0, seq))]), repository_id)
    changes.unpersist()
    return n_fresh + n_dead


def merged(tx: Transaction, folders: list[str]) -> list[str]:
    """The segments after merging each level that is full. Tombstones stay as long as there are older segments for them to void."""
    level = 0
    while True:
        mine = [f for f in folders if place(f)[0] == level]
        if len(mine) < FULL:
            if not any(place(f)[0] > level for f in folders):
                return folders
            level += 1
            continue
        rest = [f for f in folders if f not in mine]
        rows = tx.store.read_folders("grams", mine)
        last = max(place(f)[1] for f in mine)
        if any(place(f)[1] < last for f in rest):
            tombs = rows.filter("gram IS NULL").groupBy("repository_id", "gram", "text", "id", "file_id").agg(F.max("seq").alias("seq"))
            rows = alive(rows).unionByName(tombs)
        else:
            rows = alive(rows)
        folders = [*rest, tx.stage("grams", rows, label(level + 1, last))]
        level += 1


def bulk(symbols: DataFrame) -> DataFrame:
    """The rows of a whole index, for all repositories at once."""
    return postings(symbols).withColumn("seq", F.lit(0))


def searchable(store: CatalogStore, repositories: list[int] | None = None) -> DataFrame:
    """The stored postings, of some repositories or of all. Where each has one segment nothing can be void and nothing is compared."""
    parts = store.current.tables.get("grams", {})
    wanted = parts if repositories is None else {str(r): parts.get(str(r), []) for r in repositories}
    rows = store.read("grams", repositories)
    return rows if all(len(f) <= 1 for f in wanted.values()) else alive(rows)
