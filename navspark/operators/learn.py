"""The learning loop: interaction events, attributed to definitions as of their line, rolled up into pick counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from navspark.store import CatalogStore, Transaction

KEY = ["repository_id", "query_norm", "file", "name"]
#: Events of one file that are put in order together.
BLOCK = 100_000
#: Folders of events or counts from which they are written as one.
MANY = 32


def attribute(events: DataFrame, symbols: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds name, the definition that each event is about; events without one go.

    With a line it is the last definition of the file that begins at or above it, of those in one line the first by
    name; without, the file's first class or module. symbols: repository_id, file, name, kind, line.

    An as-of join: definitions and events of a file are put in one order by line and the last definition is carried forward, so that no event
    meets all definitions of its file. A file with more than ``block`` events is dealt over as many parts as it has blocks, each with the
    file's definitions.
    """
    whole = events.dropna(subset=["query", "repository_id", "path"])
    keys = ["repository_id", "path"]
    defined = symbols.select("repository_id", F.col("file").alias("path"), "name", "kind", F.col("line").alias("at"))
    at_line = defined.groupBy(*keys, "at").agg(F.min("name").alias("name"))  # of those in one line the first by name
    lined, parts = whole.filter("line IS NOT NULL"), F.coalesce("_parts", F.lit(1))
    hot = lined.groupBy(*keys).count().filter(F.col("count") > block).select(*keys, F.ceil(F.col("count") / block).alias("_parts"))
    dealt = lined.join(hot, keys, "left").withColumn("_part", F.pmod(F.xxhash64("id"), parts))
    given = at_line.join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    asked = dealt.select(*keys, "_part", F.col("line").alias("at"), F.lit(1).alias("_is"), "id", F.lit(None).cast("string").alias("name"))
    line = given.select(*keys, "_part", "at", F.lit(0).alias("_is"), F.lit(None).cast("long").alias("id"), "name").unionByName(asked)
    order = Window.partitionBy(*keys, "_part").orderBy("at", "_is").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    above = line.withColumn("name", F.last("name", ignorenulls=True).over(order)).filter("_is = 1 AND name IS NOT NULL").select("id", "name")
    first = defined.filter(F.col("kind").isin("class", "module")).groupBy(*keys).agg(F.min_by("name", F.struct("at", "name")).alias("name"))
    by_file = whole.filter("line IS NULL").join(first, keys).select("id", "name")
    return whole.join(above.unionByName(by_file), "id")


def pick_counts(events: DataFrame, symbols: DataFrame) -> DataFrame:
    """selections and last_selected_at by key, of open and select events."""
    picked = attribute(events.filter(F.col("type").isin("open", "select")), symbols)
    return picked.groupBy("repository_id", F.col("query").alias("query_norm"), F.col("path").alias("file"), "name").agg(
        F.count(F.lit(1)).alias("selections"), F.max("ts").alias("last_selected_at")
    )


def folded(counts: DataFrame) -> DataFrame:
    """Pick counts of any number of batches as one row for each key."""
    return counts.groupBy(*KEY).agg(F.sum("selections").alias("selections"), F.max("last_selected_at").alias("last_selected_at"))


def merge_counts(stats: DataFrame, counts: DataFrame) -> DataFrame:
    """Old and new pick counts as one table."""
    return folded(stats.select(*KEY, "selections", "last_selected_at").unionByName(counts))


def numbered(events: DataFrame, last: int) -> DataFrame:
    """Gives events of one appended batch the ids after ``last``. Each partition numbers its own rows, on from the rows of those before it."""
    columns = [c for c in events.columns if c != "id"]
    rows = events.select(*columns).withColumn("_at", F.monotonically_increasing_id())
    parts = rows.withColumn("_part", F.shiftright("_at", 33)).groupBy("_part").count()
    before = parts.withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each partition
    place = F.col("_at").bitwiseAND((1 << 33) - 1)
    return rows.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(before), "_part").select(*columns, (F.lit(last + 1) + F.col("_before") + place).alias("id"))


def next_batch(events: DataFrame, mark: int, size: int | None, last: int | None = None) -> tuple[DataFrame, int, int]:
    """(the next ``size`` open and select events after ``mark`` by id, how many, the new mark). Without a size all of them.

    A batch that is not full has drained the log: the mark moves to the last event of any type.
    """
    pending = events.filter((F.col("id") > mark) & F.col("type").isin("open", "select"))
    pending = pending if size is None else pending.orderBy("id").limit(size)
    taken = pending.agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top")).first()
    last = events.agg(F.max("id").alias("top")).first().top if last is None else last
    return pending, taken.n, taken.top if size is not None and taken.n == size else max(mark, last or 0)


def prune_below(mark: int, largest: int, keep: int) -> int:
    """The largest id that may go: rolled up, and not among the last ``keep``."""
    return min(mark, largest - keep)


def prune_events(events: DataFrame, mark: int, keep: int) -> DataFrame:
    largest = events.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first().top
    limit = prune_below(mark, largest, keep)
    return events.filter(F.col("id") > limit) if limit > 0 else events


def selections_for(stats: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, picks) whose stored query the query begins with, by equality with one of its beginnings."""
    whole = F.translate(F.col("query"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    heads = F.transform(F.sequence(F.lit(1), F.length(whole)), lambda n: F.substring(whole, F.lit(1), n))
    return stats.join(queries.filter("query <> ''").select("query_id", F.explode(heads).alias("query_norm")), "query_norm")


class EventLog:
    """Events and the pick counts folded from them, in a store. symbols: gives the symbols of some repositories.

    Appending adds a folder and writes nothing again. Folding adds the counts of a batch as a folder of their own, in the manifest that moves the
    high-water mark: an event counts once, whether a job fails before that or is run again after it.
    """

    def __init__(self, store: CatalogStore, symbols: Callable[[list[int]], DataFrame]):
        self.store, self.symbols = store, symbols

    def picks(self) -> DataFrame:
        """Pick counts: the sum of what each batch of events has added."""
        return folded(self.store.read("selection_stats"))

    def append(self, events: DataFrame, source: str | None = None, version: int = 0) -> int:
        """Adds a batch of events, numbered on from the last. The last number.

        A source numbers its batches upwards, and each is taken once: one that is sent again, by whoever tries it again, changes nothing. Nulls in
        any column are kept as they are; an empty batch changes nothing but that its version is known."""

        def work(tx):
            last = int(tx.base.meta.get("event_seq", 0))
            if source is not None and version <= int(tx.base.meta.get(f"source:{source}", -1)):
                return last
            folder = tx.stage("events", numbered(events, last))
            top = self.store.read_folders("events", [folder]).agg(F.max("id").alias("top")).first().top or last
            tx.append("events", [folder])
            tx.meta["event_seq"] = tx.meta[f"events:{folder}"] = str(top)
            if source is not None:
                tx.meta[f"source:{source}"] = str(version)
            return top

        return self.store.transact(work)

    def roll_up(self, size: int | None, keep: int = 0) -> int:
        """Folds the next ``size`` picks (all, without a size) into the counts and prunes events but the last ``keep``; how many picks.

        Only folders with events above the mark are read, and of symbols only the batch's repositories."""
        return self.store.transact(lambda tx: self._roll_up(tx, size, keep))

    def _roll_up(self, tx: Transaction, size: int | None, keep: int) -> int:
        mark, last = int(tx.base.meta.get("events_hwm", 0)), int(tx.base.meta.get("event_seq", 0))
        folders = tx.base.folders("events", "")
        top = {f: int(tx.base.meta.get(f"events:{f}", last)) for f in folders}
        batch, taken, now_at = next_batch(self.store.read_folders("events", [f for f in folders if top[f] > mark]), mark, size, last)
        if taken:
            # one number for each repository that the batch names
            repos = [r.repository_id for r in batch.select("repository_id").distinct().collect() if r.repository_id is not None]
            symbols = self.symbols(repos).select("repository_id", "file", "name", "kind", "line")
            tx.append("selection_stats", [tx.stage("selection_stats", pick_counts(batch, symbols))])
        if now_at != mark:
            tx.meta["events_hwm"] = str(now_at)
        self._compact(tx, folders, top, prune_below(now_at, last, keep))
        return taken

    def _compact(self, tx: Transaction, folders: list[str], top: dict[str, int], limit: int) -> None:
        """Folders that hold only events that may go are dropped unread; many small folders of events, or of counts, become one."""
        kept = [f for f in folders if top[f] > limit]
        gone = [f for f in folders if top[f] <= limit]
        if len(kept) > MANY:
            folder = tx.stage("events", self.store.read_folders("events", kept).filter(F.col("id") > limit))
            tx.meta[f"events:{folder}"] = str(max(top[f] for f in kept))
            kept, gone = [folder], folders
        if gone:
            tx.replace("events", kept)
            tx.meta |= {f"events:{f}": None for f in gone}
        counts = tx.base.folders("selection_stats", "")
        if len(counts) > MANY:
            tx.replace("selection_stats", [tx.stage("selection_stats", folded(self.store.read_folders("selection_stats", counts)))])
