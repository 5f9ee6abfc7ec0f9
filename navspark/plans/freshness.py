"""Whether a checkout has moved since it was indexed, and which files its branch changed: asked of git as seldom as the answer allows."""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor

from navspark.sources import files as SRC
from navspark.store import CatalogStore

#: Seconds that a list of branch files is served before it is worked out anew. A commit or checkout changes the stamp; an edit does not.
TTL = 15


def worktree_changed(root: str, indexed_head: str | None) -> bool:
    """Another HEAD than was indexed, or edits that are not committed; always so if no HEAD was recorded."""
    return indexed_head is None or SRC.head_changed(indexed_head, root) or SRC.is_dirty(root)


class BranchFiles:
    """Files that branches changed, kept in the store's metadata with a stamp of the checkout and the time.

    They only lift scores, so a list that has aged is served at once and worked out anew beside it, for the next call to keep.
    """

    def __init__(self, store: CatalogStore, clock: Callable[[], float], compute: Callable[[str], list[str]] = SRC.branch_changed_files):
        self.store, self.clock, self.compute = store, clock, compute
        self._pool = ThreadPoolExecutor(1, thread_name_prefix="branch-files")
        self._pending: dict[str, tuple[str, Future]] = {}

    def _keep(self, identity: str, stamp: str, files: list[str]) -> None:
        def work(tx):
            tx.meta[f"branch_files:{identity}"] = json.dumps({"stamp": stamp, "at": int(self.clock()), "files": files})

        self.store.transact(work)

    def get(self, root: str, identity: str) -> list[str]:
        if identity in self._pending and self._pending[identity][1].done():
            stamp, future = self._pending.pop(identity)
            self._keep(identity, stamp, future.result())
        stamp, held = SRC.branch_stamp(root), self.store.meta.get(f"branch_files:{identity}")
        if held is None:
            files = self.compute(root)
            if files:
                self._keep(identity, stamp, files)
            return files
        known = json.loads(held)
        if (known["stamp"] != stamp or self.clock() - known["at"] >= TTL) and identity not in self._pending:
            self._pending[identity] = (stamp, self._pool.submit(self.compute, root))
        return known["files"]

    def settle(self) -> None:
        """Waits for what is being worked out."""
        for _, future in self._pending.values():
            future.result()
