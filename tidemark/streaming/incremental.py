"""Incremental consumption of a table: what changed since the version that was processed last."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame

from tidemark.sources.store import Store
from tidemark.sources.table import Table


class Consumer:
    """Remembers, in a file, the version up to which a table's changes were handled.

    ``poll`` hands the changes (rows with version columns and ``change``) of all newer
    versions to a function and then moves the mark; if the function fails, the mark
    stays, so every change is handled at least once.
    """

    def __init__(self, table: Table, state: str, name: str = "consumer"):
        self.table, self.store, self.file = table, Store(table.spark, state), f"{name}.json"

    @property
    def version(self) -> int:
        return json.loads(self.store.read(self.file))["version"] if self.store.exists(self.file) else 0

    def poll(self, handle: Callable[[DataFrame, int], None]) -> int:
        """The version that is handled now."""
        now, before = self.table.manifest().version, self.version
        if now > before:
            handle(self.table.changes(before, now), now)
            self.store.write(self.file, json.dumps({"version": now}))
        return now
