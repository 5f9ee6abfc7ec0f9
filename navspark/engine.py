"""The engine: index, search, search_many, outline, status, drop, record over one store."""

from __future__ import annotations

import contextlib
import logging
import os
import threading
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navspark.functions.textcols import body_span, identity_of, signature
from navspark.operators import gram_index, learn, maintain, rank, recall, render
from navspark.operators import score as SC
from navspark.operators.learn import EventLog
from navspark.operators.prune import prune
from navspark.plans.freshness import BranchFiles, worktree_changed
from navspark.plans.query import QuerySpec, parse_wait
from navspark.plans.query import budget as default_budget
from navspark.schemas import EVENT_TYPES, SHOW_FROM, TABLES, struct
from navspark.sources import files as SRC
from navspark.store import PARTITIONED, CatalogStore, default_path

log = logging.getLogger("navspark")
#: Events rolled up at once and kept after that.
ROLLUP_BATCH, KEEP_EVENTS = 256, 200
#: Changed files that the first pass of a bounded index takes.
SLICE = 2_000
HIT = ["query_id", "name", "kind", "language", "file", "line", "end_line", "parent", "visibility", "repo", "confidence", "features", "score", "rank"]


class NavEngine:
    """Searches are lazy DataFrames; index, drop and record write new table versions."""

    def __init__(self, spark: SparkSession, path: str, clock=time.time):
        self.spark, self.store, self.clock = spark, CatalogStore(spark, path), clock
        self.events = EventLog(self.store, lambda repos: self.store.read("symbols", repos))
        self.branch = BranchFiles(self.store, clock)
        self.profile: dict[str, float] = {}

    @classmethod
    def open(cls, spark: SparkSession, path: str | None = None, **kwargs) -> NavEngine:
        """The engine over a store at a path, or where `store.default_path` says."""
        return cls(spark, path or default_path(spark), **kwargs)

    def now(self) -> int:
        return int(self.clock())

    def _timed(self, name: str, began: float) -> None:
        self.profile[name] = self.profile.get(name, 0.0) + time.perf_counter() - began
        log.debug("%s took %.3f s", name, time.perf_counter() - began)

    # ---- building

    def _identity(self, root: str) -> str:
        row = self.spark.createDataFrame([(SRC.remote_url(root), root)], "remote string, root string")
        return row.select(identity_of(F.col("remote"), F.col("root")).alias("i")).first().i

    def repository_id(self, root: str) -> int | None:
        """The repository that a checkout belongs to: as it was entered, or else as git names it now."""
        at = os.path.abspath(root)
        row = self.store.read("checkouts").filter(F.col("root_path") == at).select(F.col("repository_id").alias("id")).first()
        row = row or self.store.read("repositories").filter(F.col("identity") == self._identity(at)).select("id").first()
        return row.id if row else None

    def roots(self, repository_id: int) -> list[str]:
        """Where a repository is checked out, the newest first."""
        rows = self.store.read("checkouts").filter(F.col("repository_id") == repository_id).orderBy(F.desc("id")).collect()
        return [r.root_path for r in rows]

    def readable_root(self, repository_id: int, path: str, otherwise: str | None = None) -> str | None:
        """The newest checkout in which a file can be read, else the folder given if it can be read there."""
        places = [*self.roots(repository_id), *([otherwise] if otherwise else [])]
        return next((r for r in places if os.access(os.path.join(r, path), os.R_OK)), None)

    def _enter(self, root: str, identity: str) -> int:
        """The repository's id, after it and the checkout are entered and checkouts that are gone are forgotten."""
        branch = SRC.head_branch(root)

        def work(tx):
            new = self.spark.createDataFrame([(identity, branch)], "identity string, default_branch string")
            repositories = maintain.upsert_repositories(tx.read("repositories"), new, self.now()).cache()
            repo = repositories.filter(F.col("identity") == identity).first().id
            checkout = self.spark.createDataFrame([(repo, root, branch)], "repository_id long, root_path string, current_branch string")
            alive = [r.root_path for r in tx.read("checkouts").select("root_path").collect() if os.path.isdir(r.root_path)]
            checkouts = maintain.upsert_checkouts(tx.read("checkouts").filter(F.col("root_path").isin(alive)), checkout)
            for name, df in (("repositories", repositories), ("checkouts", checkouts)):
                tx.replace(name, [tx.stage(name, df)])
            repositories.unpersist()
            return repo

        return self.store.transact(work)

    def _put(self, tx, repo: int, files: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Stages a repository's files and symbols and, for the files whose content is not what it was, their part of the gram index."""
        stored = tx.read("files", [repo])
        folder = tx.stage("files", files)
        tx.replace("files", [folder], repo)
        files = self.store.read_folders("files", [folder])
        folder = tx.stage("symbols", maintain.located(symbols, files))
        tx.replace("symbols", [folder], repo)
        symbols = self.store.read_folders("symbols", [folder])
        gram_index.add_segment(tx, repo, symbols, gram_index.changed(stored, files))
        return files, symbols

    def index(self, root: str, under: list[str] = (), cap: int | None = None, query: str = "", budget: float | None = None) -> dict[str, int | str]:
        """Brings the catalog up to date with a checkout: changed files are parsed again, vanished ones forgotten. Only this repository's folders are written.

        With ``under`` only parts are seen, with ``cap`` only so many changed files: those of the branch first, then those whose path
        looks like the query; then nothing is forgotten and the coverage stays warming. With ``budget``, in seconds, capped passes follow one
        another until all is done or the time is up; jobs at work then are cancelled, what earlier passes did stays, and the next call goes on.
        """
        began = time.perf_counter()
        root = os.path.abspath(root)
        identity = self._identity(root)
        repo = self._enter(root, identity)
        counts: dict[str, int | str] = {"files_seen": 0, "files_indexed": 0, "symbols": 0, "status": "warming"}
        done, limit = 0, cap if budget is None else SLICE
        while True:
            left = None if budget is None else budget - (time.perf_counter() - began)
            if left is not None and left <= 0:
                break
            with self._deadline(left) as late:
                try:
                    counts = self.store.transact(lambda tx, most=limit: self._index(tx, root, identity, repo, list(under), most, query))
                except Exception:
                    if not late.is_set():
                        raise
                    break
            done += counts["files_indexed"]
            if budget is None or counts["files_indexed"] < limit:
                break
            limit *= 2  # each pass lists the tree again
        if budget is not None:
            counts["files_indexed"] = done
        self._timed("index", began)
        return counts

    @contextlib.contextmanager
    def _deadline(self, seconds: float | None):
        """Cancels the jobs that are started inside when the time is up; gives an event that tells whether it was."""
        late, context, tag = threading.Event(), self.spark.sparkContext, f"navspark-{uuid.uuid4().hex}"
        if seconds is None:
            yield late
            return

        def stop():
            late.set()
            context.cancelJobsWithTag(tag)

        timer = threading.Timer(seconds, stop)
        context.addJobTag(tag)
        timer.start()
        try:
            yield late
        finally:
            timer.cancel()
            context.removeJobTag(tag)

    def is_current(self, root: str) -> bool:
        """Whether the catalog holds all of a checkout that has not moved since: same HEAD, no edits. Any doubt is a no."""
        repo = self.repository_id(root)
        if repo is None or self.miss(root)[0] != "no_match":
            return False
        return not worktree_changed(root, self.store.meta.get(f"head:{self._identity(os.path.abspath(root))}"))

    def warm(self, path: str, budget: float | None = None, query: str = "") -> dict[str, int | str]:
        """Indexes the repository that a path lies in unless it is current, within a budget of seconds (`plans.query.budget` has the usual ones)."""
        root = SRC.repo_root(path) or os.path.abspath(path)
        if self.is_current(root):
            return {"files_seen": 0, "files_indexed": 0, "symbols": 0, "status": "complete"}
        return self.index(root, query=query, budget=default_budget("warm") if budget is None else budget)

    def _index(self, tx, root: str, identity: str, repo: int, under: list[str], cap: int | None, query: str) -> dict[str, int | str]:
        spark, now = self.spark, self.now()
        stored, symbols = tx.read("files", [repo]), tx.read("symbols", [repo])
        seen = SRC.list_files(spark, root, under).cache()
        todo = maintain.to_parse(stored, seen)
        n_seen, pending = seen.count(), todo.count()
        budgeted = cap is not None
        if budgeted and pending > cap:
            todo = maintain.prioritized(todo, F.lit(query), self.branch.get(root, identity)).limit(cap)
        text = SRC.read_files(spark, root, todo, repo).cache()
        parsed = text.drop("text")
        files, symbols = maintain.replace_files(stored, symbols, parsed, SRC.extract_symbols(text), now)
        complete = not (budgeted and pending > cap)
        flags = (complete, not under, n_seen == 0, not stored.isEmpty(), budgeted)
        o = spark.range(1).select(maintain.sweep_outcome(*map(F.lit, flags)).alias("o")).first().o
        if o.finalize:
            files, symbols = maintain.forget_files(files, symbols, maintain.reconcile(files, seen))
        head, mark = SRC.git_head(root), f"git_ts_head:{identity}"
        if head and head != tx.base.meta.get(mark):
            files = maintain.set_git_times(files, maintain.latest_commit_times(SRC.commit_log(spark, root, tx.base.meta.get(mark))))
        if head and o.finalize:  # files that a later pass adds need the whole log
            tx.meta |= {mark: head, f"head:{identity}": head}
        files, symbols = self._put(tx, repo, files, symbols)
        n_files = files.count()
        status = spark.range(1).select(maintain.settle_status(F.lit(o.status), F.lit(n_files)).alias("s")).first().s
        covered = spark.createDataFrame([(repo, repo, "full", n_seen, n_files, status, now)], struct("coverage"))
        tx.replace("coverage", [tx.stage("coverage", covered)], repo)
        counts = {"files_seen": n_seen, "files_indexed": parsed.count(), "symbols": symbols.count(), "status": status}
        for df in (seen, text):
            df.unpersist()
        return counts

    def refresh(self, root: str, paths: list[str]) -> bool:
        """Parses some files again if their content changed; unreadable ones count as unchanged. Whether any changed."""
        repo = self.repository_id(root)
        rows = [(p, n, SRC.file_mtime(os.path.join(root, p))) for n, p in enumerate(dict.fromkeys(paths))]
        text = SRC.read_files(self.spark, root, self.spark.createDataFrame([r for r in rows if r[2] is not None], SRC.LISTED), repo).cache()

        def work(tx):
            stored = tx.read("files", [repo])
            changed = maintain.changed_files(stored, text).filter("status <> 'same'").count() > 0
            if changed:
                self._put(tx, repo, *maintain.replace_files(stored, tx.read("symbols", [repo]), text.drop("text"), SRC.extract_symbols(text), self.now()))
            return changed

        changed = self.store.transact(work)
        text.unpersist()
        return changed

    def drop(self, root_or_identity: str) -> dict[str, bool]:
        """Forgets a repository; one that is unknown is no error."""
        names = [root_or_identity, f"local:{os.path.abspath(root_or_identity)}"]
        names += [self._identity(os.path.abspath(root_or_identity))] if os.path.isdir(root_or_identity) else []

        def work(tx):
            row = tx.read("repositories").filter(F.col("identity").isin(names)).first()
            if not row:
                return {"dropped": False}
            whole = {t: tx.read(t) for t in TABLES if t not in PARTITIONED}
            for name, df in maintain.drop_repository(whole, row.id).items():
                tx.replace(name, [tx.stage(name, df)])
            for name in PARTITIONED:
                tx.replace(name, [], row.id)
            tx.meta |= {f"head:{row.identity}": None, f"git_ts_head:{row.identity}": None}
            return {"dropped": True}

        return self.store.transact(work)

    # ---- asking

    def _named(self, hits: DataFrame) -> DataFrame:
        """Hits with the identity of their repository."""
        return hits.join(self.store.read("repositories").select(F.col("id").alias("repository_id"), F.col("identity").alias("repo")), "repository_id")

    def _rank(self, symbols: DataFrame, pairs: DataFrame, asked: DataFrame, k: int, boosted: bool = True, pruned: bool = False) -> DataFrame:
        rows = bare = recall.fitting(SC.prepare_pairs(symbols, asked, pairs)).withColumn("now", F.lit(self.now()))
        if boosted:
            boosts = SC.learned_boosts(self.events.picks(), asked, F.lit(self.now())).withColumnRenamed("learned", "learned_value")
            rows = rows.join(boosts, ["query_id", "repository_id", "file", "name"], "left")
        else:
            rows = rows.withColumn("learned_value", F.lit(None).cast("double"))
        rows = prune(rows, k, bare) if pruned else rows
        return SC.list_features(rank.top_k(SC.score_values(rows), k))

    def _sources(self, repositories: list[int] | None) -> tuple[DataFrame, DataFrame]:
        """Symbols and gram postings as they are stored."""
        return self.store.read("symbols", repositories), gram_index.searchable(self.store, repositories)

    def _live_sources(self, repositories: list[int] | None, root: str, repo: int) -> tuple[DataFrame, DataFrame]:
        """Symbols and gram postings as an index of the checkout would leave them: what changed or is new is read from its files, and stands for
        what is stored of these and of files that are gone."""
        symbols, index = self._sources(repositories)
        stored, seen = self.store.read("files", [repo]), SRC.list_files(self.spark, root)
        text = SRC.read_files(self.spark, root, maintain.to_parse(stored, seen), repo)
        files, mine = maintain.replace_files(stored, self.store.read("symbols", [repo]).limit(0), text.drop("text"), SRC.extract_symbols(text), self.now())
        changes = gram_index.changed(stored, files.join(seen.select("path"), "path", "left_semi"))
        live = maintain.located(mine, files)
        of_file = changes.select("file_id")
        symbols = symbols.join(of_file, "file_id", "left_anti").unionByName(live.select(symbols.columns))
        fresh = gram_index.postings(live).withColumn("seq", F.lit(None).cast("long"))
        return symbols, index.join(of_file, "file_id", "left_anti").unionByName(fresh.select(index.columns))

    def search_many(
        self,
        queries: DataFrame,
        limit: int = 10,
        all_repos: bool = True,
        spec: QuerySpec | None = None,
        repositories: list[int] | None = None,
        sources: tuple[DataFrame, DataFrame] | None = None,
        pruned: bool = False,
    ) -> DataFrame:
        """Hits of a whole table of queries (query_id, query and, if wanted, current_repo_id and changed_files).

        With ``repositories`` only their folders of the index and of the symbols are read; without all_repos each query sees its current_repo_id only.
        With ``pruned`` a first pass over the candidates finds a score that each query's best hits reach, and what cannot reach it is not matched:
        the same hits, for large batches on large catalogs."""
        asked = queries
        if "current_repo_id" not in asked.columns:
            asked = asked.withColumn("current_repo_id", F.lit(None).cast("long"))
        if "changed_files" not in asked.columns:
            asked = asked.withColumn("changed_files", F.array().cast("array<string>"))
        asked, (symbols, index) = recall.recall_queries(asked), sources or self._sources(repositories)
        if spec:  # one query: its grams are a filter on the sorted postings
            index = index.filter(F.col("gram").isin(recall.grams_of(asked)))
        hits = self._rank(symbols, recall.recall_many(index, asked, scoped=not all_repos), asked, spec.ranked if spec else limit, pruned=pruned)
        return self._finish(self._named(hits), spec, limit)

    def _finish(self, hits: DataFrame, spec: QuerySpec | None, limit: int) -> DataFrame:
        """Gates, filters, cut, confidence, in this order."""
        hits = rank.scope_gate(rank.relevance_gate(hits))
        if spec and spec.filtered:
            hits = rank.post_filter(hits, list(spec.paths), list(spec.kinds), list(spec.langs))
        return rank.attach_confidence(rank.top_k(hits.drop("rank"), limit)).select(HIT)

    def search(
        self, target: str, root: str | None = None, paths=(), kinds=(), langs=(), limit: int = 10, all_repos: bool = False, fresh: bool = False, live: bool = False, wait: str | None = None
    ) -> DataFrame:
        """Hits of one query, best first. With a root its repository is the current one and, unless all_repos, the only one.

        With ``fresh`` the files of the hits are looked at first: if any has changed it is parsed again and the search is run once more. With ``live``
        all files that are not indexed as they are now are read for this answer, and nothing is stored. ``wait``, such as 2s or 500ms, is
        how long a repository that has moved may be indexed before; "" stands for the usual time."""
        if wait is not None and root:
            seconds = parse_wait(wait) if wait else default_budget("wait")
            if seconds is None:
                raise ValueError(f"{wait!r} is no time to wait")
            self.warm(root, seconds, target)
        repo = self.repository_id(root) if root else None
        if fresh and repo is not None and self._refresh_hits(self.search(target, root, paths, kinds, langs, limit, all_repos), root, repo):
            return self.search(target, root, paths, kinds, langs, limit, all_repos)
        spec = QuerySpec.of(target, paths, kinds, langs, limit, all_repos)
        changed = self.branch.get(root, self._identity(os.path.abspath(root))) if root else []
        row = [(1, spec.query, repo, changed)]
        queries = self.spark.createDataFrame(row, "query_id long, query string, current_repo_id long, changed_files array<string>")
        only = None if all_repos or repo is None else [repo]
        sources = self._live_sources(only, root, repo) if live and repo is not None else None
        return self.search_many(queries, limit, True, spec, only, sources).orderBy("rank")

    def _refresh_hits(self, hits: DataFrame, root: str, repo: int) -> bool:
        """Parses the files of a page of hits again whose times are not the stored ones. Whether any had changed."""
        mine = {r.file for r in hits.collect() if r.repo == self._identity(os.path.abspath(root))}
        known = {r.path: r.mtime for r in self.store.read("files", [repo]).filter(F.col("path").isin(sorted(mine))).collect()}
        moved = [p for p, mtime in known.items() if SRC.file_mtime(os.path.join(root, p)) != mtime]
        return bool(moved) and self.refresh(root, moved)

    def live_search(self, target: str, root: str, limit: int = 10, indexed: DataFrame | None = None, cap: int | None = None) -> DataFrame:
        """Hits in files as they lie there, without the catalog: first those that hold the query literally, else all.

        With ``cap`` only so many files are read, those first whose path looks like the query."""
        spec = QuerySpec.of(target, limit=limit)
        row = [(1, spec.query, -1, [])]
        asked = recall.recall_queries(self.spark.createDataFrame(row, "query_id long, query string, current_repo_id long, changed_files array<string>"))
        key = asked.first().key
        for needle in (key, None):
            found = SRC.live_symbols(self.spark, root, needle, indexed, cap, spec.query).withColumn("id", F.xxhash64("path", "line", "name", "kind"))
            symbols = found.select(
                "*", F.col("path").alias("file"), F.lit("live").alias("repo"), F.lower("name").alias("name_lower"), *(F.lit(None).cast("long").alias(c) for c in ("mtime", "git_ts"))
            ).cache()
            pairs = symbols.select(F.lit(1).cast("long").alias("query_id"), "id")
            hits = self._rank(symbols, pairs, asked, spec.limit, boosted=False)
            if not hits.isEmpty():
                break
        return hits

    def outline(self, root: str, path: str, kinds=(), langs=()) -> DataFrame:
        """The definitions of one file, in order."""
        repo = self.repository_id(root) or -1
        rows = self._named(maintain.outline(self.store.read("symbols", [repo]), repo, path)).orderBy("line", "name")
        return rank.post_filter(rows, [], list(kinds), list(langs)).select("name", "kind", "language", "file", "line", "end_line", "parent", "visibility", "repo")

    def with_source(self, hits: DataFrame, root: str, body: bool = False) -> DataFrame:
        """Adds each hit's signature line and, if wanted, its body, from the files of a checkout."""
        paths = [(r.file, n, 0) for n, r in enumerate(hits.select("file").distinct().collect())]  # a page of hits
        listed = self.spark.createDataFrame([p for p in paths if os.path.isfile(os.path.join(root, p[0]))], SRC.LISTED)
        text = SRC.read_files(self.spark, root, listed, -1).select(F.col("path").alias("file"), "text")
        joined = hits.join(text, "file", "left").withColumn("signature", signature(F.col("text"), F.col("line")))
        joined = joined.withColumn("body", body_span(F.col("text"), F.col("line"), F.col("end_line"))) if body else joined
        return joined.drop("text")

    def text(self, hits: DataFrame, target: str, root: str | None = None, color: str | None = None, explain: bool = False) -> DataFrame:
        """Hits with a column text: what a reader sees, best first. With a root it shows the lines of the definitions, with a color (such as 1;32) what matched."""
        return render.add_text(self.with_source(hits, root) if root else hits, F.lit(target), color, explain).orderBy("query_id", "rank")

    def write(self, hits: DataFrame, path: str, queries: DataFrame | None = None) -> None:
        """Hits as files of JSON, one row a line; of a table of queries each row begins with its query."""
        tagged = hits if queries is None else hits.join(queries.select("query_id", "query"), "query_id")
        render.write_rows(tagged, path, [*([] if queries is None else ["query"]), *HIT[1:]])

    def show(self, target: str, root: str) -> DataFrame:
        """The body of the best hit if it is certain enough, else the list of hits; files that have changed are parsed again first."""
        hits = self.search(target, root, fresh=True)
        best = hits.first()
        return self.with_source(hits.limit(1), root, body=True) if best and best.confidence >= SHOW_FROM else self.with_source(hits, root)

    def miss(self, root: str, interrupted: bool = False) -> tuple[str, int]:
        """(status, exit code) of a search without hits."""
        row = self.store.read("coverage", [self.repository_id(root) or -1]).filter("scope = 'full'").first()
        status = "interrupted" if interrupted else ("no_match" if row and row.status == "complete" else "warming")
        return status, 1 if status == "no_match" else 2

    def status(self) -> DataFrame:
        return maintain.coverage_overview(*(self.store.read(t) for t in ("repositories", "coverage", "files", "symbols")))

    # ---- learning

    def record(self, event: str, query: str, root: str, path: str, line: int | None = None) -> int:
        """Appends what a user picked and rolls new events up. How many were rolled up."""
        if event not in EVENT_TYPES[1:]:
            raise ValueError(f"{event} is not one of {EVENT_TYPES[1:]}")
        relative = os.path.relpath(path, root) if os.path.isabs(path) else path
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in query)
        row = [(event, low, self.repository_id(root), relative, line, SRC.head_branch(root), self.now())]
        self.events.append(self.spark.createDataFrame(row, "type string, query string, repository_id long, path string, line long, branch string, ts long"))
        return self.roll_up()

    def roll_up(self, size: int | None = ROLLUP_BATCH, keep: int = KEEP_EVENTS) -> int:
        return self.events.roll_up(size, keep)
