"""Joins that know how tables lie: by row address, and by shared buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.table import Table

#: A shard of more bytes of files, both sides together, is too much for one task.
SHARD_BYTES = 64 << 20


def fragment_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner") -> DataFrame:
    """Equi-join on row addresses, any join type: one exchange per side, none for a side that is small enough to broadcast."""
    return left.join(right, left[left_key] == right[right_key], how)


def shard_join(left: Table, right: Table, key: str, how: str = "inner") -> DataFrame:
    """Join on ``key`` of two tables sharded by it in the same way: shard by shard, as they lie, without an exchange.

    A shard is one task, so buckets should be as many as the join's tasks; shards of more
    than SHARD_BYTES are joined by an exchange on the key, all in one.
    """
    a, b = left.manifest(), right.manifest()
    if not a.sharding or a.sharding != b.sharding or a.sharding[-1] != key:
        raise ValueError("both tables must be sharded by the key in the same way")
    of = lambda m, shard: {f["id"] for f in m.fragments if f.get("shard") == shard}
    small, large = [], (set(), set())
    for shard in sorted({f.get("shard") for m in (a, b) for f in m.fragments}, key=str):
        ids = of(a, shard), of(b, shard)
        if not (ids[0] and ids[1]) and how == "inner":
            continue
        if sum(f["bytes"] for m in (a, b) for f in m.fragments if f.get("shard") == shard) > SHARD_BYTES:
            large[0].update(ids[0])
            large[1].update(ids[1])
        else:
            small.append(ids)
    out = None
    for ids, whole in [(x, True) for x in small] + ([(large, False)] if any(large) else []):
        sides = [t.read(version=m.version, fragments=x) for t, m, x in zip((left, right), (a, b), ids, strict=True)]
        sides = [s.coalesce(1) for s in sides] if whole else sides
        part = sides[0].join(sides[1], key, how)
        out = part if out is None else out.union(part)
    return out if out is not None else left.read(version=a.version).join(right.read(version=b.version), key, how)


def sized_broadcast(df: DataFrame, table_bytes: int, limit: int = 32 << 20) -> DataFrame:
    """A broadcast hint only if the manifest proves the table small."""
    return F.broadcast(df) if table_bytes <= limit else df


def table_join(left: Table, right: Table, on: list[str], how: str = "inner", left_where: str | None = None, right_where: str | None = None, limit: int = 32 << 20) -> DataFrame:
    """Join of two tables' latest rows on columns of the same name; a side is broadcast if its manifest proves it small and the join's type allows it.

    Spark sizes a scan by its files alone; the manifest also knows which fragments a
    condition leaves and which rows were deleted.
    """
    versions = left.manifest().version, right.manifest().version
    sides = [t.read(version=v, where=w) for t, v, w in zip((left, right), versions, (left_where, right_where), strict=True)]
    sizes = [t.statistics(w, version=v)["bytes"] for t, v, w in zip((left, right), versions, (left_where, right_where), strict=True)]
    may = {"inner": (True, True), "left": (False, True), "left_semi": (False, True), "left_anti": (False, True), "right": (True, False)}.get(how, (False, False))
    small = min((0, 1), key=lambda i: (not may[i], sizes[i]))
    if may[small]:
        sides[small] = sized_broadcast(sides[small], sizes[small], limit)
    return sides[0].join(sides[1], on, how)
