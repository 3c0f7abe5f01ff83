"""N-gram Jaccard join, size-aware: subsets for small sets, inverted lists for large ones.

A document's set holds the hashes of its distinct k-word shingles.  Equal sets form
classes; one representative each goes on.

Light sets (few shingles): two sets of sizes n and m reach the similarity exactly when
they share a subset of c(n, m) shingles, so every set emits all its subsets of the
sizes its partners call for, and sets that meet under a subset are linked: no pair is
compared.  Heavy sets: each set enters the inverted lists of its least frequent
shingles, as many as any similar set must share one of; lists are scanned in order and
give candidate pairs, which are verified on the whole sets.  The boundary is where the
subsets' cost passes the lists' cost for the sizes at hand.

Long lists don't give all their pairs.  They are dealt into sub-lists, whose members
are first compared with one pivot.  Only where a list's members still lie in different
components afterwards are they compared with each other, in tiles of bounded size: first
by bitmaps, then those with a partner on their whole sets.  A tile gives a spanning forest
of its links, so no link between components is lost and no list gives all its pairs.

A fixed-size sketch of shingle counts orders the shingles; a poor order costs time only.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._shared import SHORT_ROWS, filled, forget, materialize, mix, raw_text, runs, shingle_hashes, slices, word_hashes
from tidemark.llm.components import connected_components

BETWEEN = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
#: Bits of the count sketch (its size bounds what is broadcast), and the least count in a task that it is told of.
SKETCH_BITS, SKETCH_LEAST = 20, 6
#: Sizes up to which sets can be light, and the cost of a list entry against a subset's.
LIGHT_MOST, LIST_COST = 14, 6
#: Members up to which a list gives all its pairs at once, and those of a sub-list of a long one.
SHORT_LIST, SUB_LIST = 4, 2048
#: Ids that may be broadcast to pick documents; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


class Shingles:
    """Sets of a slice of texts: distinct sorted hashes per text."""

    def __init__(self, texts: pa.Array, k: int):
        raw, bounds = raw_text(filled(texts))
        words, firsts = word_hashes(LOWER[raw], bounds, BETWEEN)
        self.hashes, at = shingle_hashes(words, firsts, k)
        self.cuts = np.searchsorted(at, firsts)
        self.words, self.firsts, self.k = words, firsts, k

    def __len__(self) -> int:
        return len(self.firsts) - 1

    def set(self, i: int) -> np.ndarray:
        a, b = self.firsts[i], self.firsts[i + 1]
        if 0 < b - a < self.k:  # the whole sequence counts as one shingle
            whole = self.words[a:b] * (np.arange(3, 3 + b - a, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
            return mix(np.array([whole.sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64))
        return np.unique(self.hashes[self.cuts[i] : self.cuts[i + 1]])


def fewest(n: int, m: int, percent: int) -> int:
    """Least intersection of sets of sizes n and m whose similarity is ``percent`` or more."""
    return -(-percent * (n + m) // (100 + percent))


def partners(n: int, percent: int) -> range:
    """Sizes that a set similar to one of size n can have."""
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def subset_count(n: int, most: int, percent: int) -> int:
    return sum(math.comb(n, fewest(n, m, percent)) for m in partners(n, percent) if m <= most)


def boundary(sizes: dict[int, int], percent: int, list_cost: float = LIST_COST) -> int:
    """Largest size of a light set: where subsets and list entries together cost least."""

    def cost(b: int) -> float:
        total = 0.0
        for n, count in sizes.items():
            if n <= b:
                total += count * subset_count(n, b, percent)
            if n > b or partners(n, percent)[-1] > b:
                total += count * list_cost * prefix_size(n, percent)
        return total

    return min(range(LIGHT_MOST + 1), key=lambda b: (cost(b), b))


_picks: dict[tuple[int, int], np.ndarray] = {}


#: How a set comes under a subset's key: its partners there have its own size, a larger one or a smaller one.
EQUAL, SMALLER, LARGER = -10, -11, -12


def subset_keys(hashes: np.ndarray, most: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the subsets under which a light set meets the light sets similar to it, and its role there.

    A key names both sizes.  Under a key of two sizes only sets of different sizes are similar.
    """
    n, out, roles = len(hashes), [], []
    spread = mix(hashes)
    for m in partners(n, percent):
        if m > most:
            continue
        c = fewest(n, m, percent)
        if (n, c) not in _picks:
            _picks[n, c] = np.array(list(combinations(range(n), c)), np.int64).reshape(-1, c)
        pair = np.uint64((min(n, m) << 8 | max(n, m)) * 0x9E3779B9)
        out.append(mix(spread[_picks[n, c]].sum(1, dtype=np.uint64) ^ pair))
        roles.append(np.full(len(out[-1]), EQUAL if m == n else SMALLER if m > n else LARGER, np.int32))
    return (np.concatenate(out), np.concatenate(roles)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int32))


def _keys(k: int) -> Callable:
    """Per document: size and 128-bit key of its set; per task: counts of frequent sketch cells."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("cell", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in slices(batches, "text"):
            sets = Shingles(batch.column("text"), k)
            n, k1, k2 = (np.zeros(len(sets), np.int64) for _ in range(3))
            for i in range(len(sets)):
                own = sets.set(i)
                n[i] = len(own)
                k1[i] = own.sum(dtype=np.uint64).astype(np.int64)
                k2[i] = np.bitwise_xor.reduce(mix(own)).astype(np.int64) if len(own) else 0
            cells, found = np.unique(sets.hashes >> np.uint64(64 - SKETCH_BITS), return_counts=True)
            counts[cells.astype(np.int64)] += found
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(k1), pa.array(k2), pa.nulls(len(n), pa.int64())], schema=schema)
        cells = np.flatnonzero(counts >= SKETCH_LEAST)
        none = pa.nulls(len(cells), pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.array(counts[cells]), none, none, pa.array(cells)], schema=schema)

    return run


ENTRY = T.StructType().add("key", "long").add("salt", "integer").add("n", "integer").add("id", "long")
_ENTRY = pa.schema([("key", pa.int64()), ("salt", pa.int32()), ("n", pa.int32()), ("id", pa.int64())])


def _entries(k: int, percent: int, light: int, shipped) -> Callable:
    """List entries of heavy sets (n > 0) and subset entries of light ones (n = 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = shipped.value  # logarithm of each cell's count
        for batch in slices(batches, "text"):
            sets, ids = Shingles(batch.column("text"), k), batch.column("doc_id").to_numpy()
            keys, salts, sizes, owners = [], [], [], []
            for i in range(len(sets)):
                own = sets.set(i)
                n = len(own)
                if n and n <= light:
                    subsets, roles = subset_keys(own, light, percent)
                    keys.append(subsets)
                    salts.append(roles)
                    sizes.append(np.zeros(len(subsets), np.int32))
                    owners.append(np.full(len(subsets), ids[i]))
                if n > light or n and partners(n, percent)[-1] > light:
                    level = sketch[own >> np.uint64(64 - SKETCH_BITS)]
                    order = np.argsort(level.astype(np.uint64) << np.uint64(56) | own >> np.uint64(8), kind="stable")
                    first = own[order[: prefix_size(n, percent)]]
                    parts = np.maximum(1, (1 << level[order[: len(first)]].astype(np.int64)) // SUB_LIST)
                    keys.append(first)
                    dealt = (mix(first ^ np.uint64(ids[i] & (1 << 63) - 1)) % parts.astype(np.uint64)).astype(np.int32)
                    salts.append(np.where(parts > 1, dealt, -1).astype(np.int32))
                    sizes.append(np.full(len(first), n, np.int32))
                    owners.append(np.full(len(first), ids[i]))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(salts)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(owners))], schema=_ENTRY)

    return run


FOUND = T.StructType().add("kind", "integer").add("a", "long").add("b", "long").add("key", "long").add("n", "integer")
SUBSET, PAIR, OPEN = 0, 1, 2
_FOUND = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("n", pa.int32())])


def _scan(percent: int) -> Callable:
    """Scan sorted entries run by run: pairs of heavy sets, and members of lists that stay open.

    Light sets' entries go through as they are (``n`` then holds the role).
    """

    def found(kind: int, a: np.ndarray, b: np.ndarray, key: np.ndarray | None = None, n: np.ndarray | None = None) -> pa.RecordBatch:
        zero = np.zeros(len(a), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(zero.astype(np.int32) + kind), pa.array(a), pa.array(b), pa.array(zero if key is None else key), pa.array((zero if n is None else n).astype(np.int32))], schema=_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # key, salt, n of the run's pivot and its id, when a batch ends inside a run
        for batch in batches:
            key, salt, n, ids = (batch.column(c).to_numpy() for c in ("key", "salt", "n", "id"))
            if (subsets := n == 0).any():
                yield found(SUBSET, ids[subsets], ids[subsets], key[subsets], salt[subsets])
                key, salt, n, ids = (x[~subsets] for x in (key, salt, n, ids))
            if not len(key):
                continue
            if last is not None:  # the open run's pivot goes first
                key, salt, n, ids = (np.concatenate([[x], y]).astype(y.dtype) for x, y in zip(last, (key, salt, n, ids), strict=True))
            same = (key[1:] == key[:-1]) & (salt[1:] == salt[:-1])
            start = np.flatnonzero(np.concatenate([[True], ~same]))
            length = np.diff(np.concatenate([start, [len(key)]]))
            # the pivot of each entry: its run's first, or the first that is large enough
            first = np.repeat(start, length)
            far = n[first] * 100 < percent * n
            for i in np.flatnonzero(far):
                j = first[i]
                while n[j] * 100 < percent * n[i]:
                    j += 1
                first[i] = j
            at = np.flatnonzero(first != np.arange(len(key)))
            yield found(PAIR, np.minimum(ids[first[at]], ids[at]), np.maximum(ids[first[at]], ids[at]))
            pairs, short = [], (length > 2) & (length <= SHORT_LIST)
            for s, m in zip(start[short], length[short], strict=True):
                pairs += [(min(ids[i], ids[j]), max(ids[i], ids[j])) for i in range(s + 1, s + m) for j in range(i + 1, s + m) if n[i] * 100 >= percent * n[j]]
            if pairs:
                yield found(PAIR, *np.array(pairs, np.int64).T)
            # long lists, dealt lists and those that a batch's end cuts stay open
            loose = np.repeat((length > SHORT_LIST) | (start + length == len(key)) | (start == 0), length) | (salt >= 0)
            mine = np.flatnonzero(loose)
            yield found(OPEN, ids[mine], ids[mine], key[mine], n[mine])
            p = first[-1]
            last = (key[p], salt[p], n[p], ids[p])

    return run


def _subset_links(entries: DataFrame) -> DataFrame:
    """Links of light sets: under a key, each to the least id among its partners there."""
    role, least = F.col("role"), lambda r: F.min(F.when(F.col("role") == r, F.col("id")))
    under = entries.groupBy("key").agg(least(EQUAL).alias("equal"), least(SMALLER).alias("smaller"), least(LARGER).alias("larger"))
    other = F.when(role == EQUAL, F.col("equal")).when(role == SMALLER, F.col("larger")).otherwise(F.col("smaller"))
    return entries.join(under, "key").select(F.col("id").alias("a"), other.alias("b")).filter("b is not null and a != b").distinct()


def _verify(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("left"), batch.column("right")
            kept = []
            for i in range(batch.num_rows):
                a, b = (np.frombuffer(x[i].as_buffer(), np.uint64) for x in (left, right))
                both = np.concatenate([a, b])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                kept.append(100 * shared >= percent * (len(both) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return run


def _sets(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = Shingles(batch.column("text"), k)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([sets.set(i).tobytes() for i in range(len(sets))], pa.binary())], names=["id", "hashes"])

    return run


#: Bits of a set's parity bitmap, which bounds how far two sets differ: a power of two of the set's size or more, within these.
MAP_LEAST, MAP_MOST = 512, 1 << 16


def _maps(k: int) -> Callable:
    """Per document: size of its set, and the parity of the number of hashes in each of a power of two of classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = Shingles(batch.column("text"), k)
            own = [sets.set(i) for i in range(len(sets))]
            odd = []
            for h in own:
                size = min(MAP_MOST, max(MAP_LEAST, 1 << max(0, len(h) - 1).bit_length()))
                odd.append(np.packbits(np.bincount(mix(h).astype(np.int64) & (size - 1), minlength=size) & 1 > 0).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(h) for h in own], pa.int32()), pa.array(odd, pa.binary())], names=["id", "n", "bits"])

    return run


def _by_size(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and signs (1 or -1 for each bit) of the bitmaps of each size."""
    raw = column.to_pylist()
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        bits = np.unpackbits(np.frombuffer(b"".join([raw[i] for i in at]), np.uint8)).reshape(len(at), -1)
        yield at, 1 - 2 * bits.astype(np.float32)


def _folded(signs: np.ndarray, size: int) -> np.ndarray:
    """The signs of a smaller bitmap of the same sets."""
    while signs.shape[1] > size:
        half = signs.shape[1] // 2
        signs = signs[:, :half] * signs[:, half:]
    return signs


def _allowed(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """How many elements two similar sets of these sizes can have that the other has not; below 0 if sizes differ too much."""
    total = n.astype(np.int64) + m
    most = total - 2 * -(-percent * total // (100 + percent))
    return np.where(np.minimum(n, m) * 100 >= percent * np.maximum(n, m), most, -1)


def _plausible(percent: int) -> Callable:
    """Pairs whose bitmaps don't rule the similarity out: bitmaps differ in at most as many bits as sets do in elements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_numpy().astype(np.int64) for c in ("n1", "n2"))
            allowed, kept = _allowed(n, m, percent), np.zeros(batch.num_rows, bool)
            close = np.flatnonzero(allowed >= 0)  # bitmaps of these differ in size by a factor of two at most
            one, other = (batch.column(c).take(pa.array(close)) for c in ("bits1", "bits2"))
            for i, left in _by_size(one):
                for j, right in _by_size(other):
                    both, x, y = np.intersect1d(i, j, assume_unique=True, return_indices=True)
                    size = min(left.shape[1], right.shape[1])
                    for a in range(0, len(both), step := max(1, (1 << 20) // size)):
                        differ = (size - np.einsum("ij,ij->i", _folded(left[x[a : a + step]], size), _folded(right[y[a : a + step]], size))) / 2
                        at = close[both[a : a + step]]
                        kept[at] = differ <= allowed[at]
            if batch.num_rows:
                yield batch.select(["a", "b"]).filter(pa.array(kept))

    return run


#: Members and shingles of a block of a list; lists with more are compared block against block, each two in a task.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1 << 21
#: Of so many lists (those of the least keys) a member knows the keys.
KNOWN = 8


def _tiles(member: DataFrame) -> DataFrame:
    """Lists whose members lie in different components, cut into tiles ``i``, ``j`` of two blocks (``key``, ``id``, ``group``, ``side``).

    Of lists with the same members one is left.  A list's largest component is not
    compared with itself, so its rows are copied only as often as the others need blocks.
    """
    per = member.groupBy("key", "group").agg(F.count("*").alias("c"), F.sum("n").alias("w"), *[F.bit_xor(F.xxhash64("id", F.lit(i))).alias(f"s{i}") for i in (1, 2)])
    lists = per.groupBy("key").agg(
        F.count("*").alias("groups"), F.sum("c").alias("c"), F.sum("w").alias("w"), F.max(F.struct("w", "c", "group")).alias("main"), *[F.bit_xor(f"s{i}").alias(f"s{i}") for i in (1, 2)]
    ).filter("groups > 1")
    lists = lists.groupBy("c", "w", "s1", "s2").agg(F.min(F.struct("key", "main")).alias("x")).select("x.key", "x.main", "c", "w")
    need = lambda c, w: F.greatest(F.ceil(c / BLOCK_ROWS), F.ceil(w / BLOCK_SHINGLES)).cast("int")
    one = need(F.col("c"), F.col("w")) == 1
    lists = lists.select(
        "key", F.when(one, F.lit(None)).otherwise(F.col("main.group")).alias("main"),
        F.when(one, 1).otherwise(F.greatest(F.lit(1), need(F.col("c") - F.col("main.c"), F.col("w") - F.col("main.w")))).alias("others"),
        F.when(one, 0).otherwise(need(F.col("main.c"), F.col("main.w"))).alias("mains"),
    )
    inside, spread = F.col("group").eqNullSafe(F.col("main")) & (F.col("mains") > 0), F.xxhash64("id")
    own = F.when(inside, F.col("others") + F.pmod(spread, F.col("mains"))).otherwise(F.pmod(spread, F.col("others"))).cast("int")
    against = F.when(inside, F.col("others")).otherwise(F.col("others") + F.col("mains"))
    rows = member.join(lists, "key").withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), against - 1)))
    return rows.select("key", F.least("own", "with").cast("int").alias("i"), F.greatest("own", "with").cast("int").alias("j"), (F.col("own") > F.col("with")).cast("int").alias("side"), "id", "group")


def _partnered(percent: int) -> Callable:
    """Members of a tile with a partner there: one of another component that bitmaps don't rule out.

    A pair counts in the first of the lists that both are known to be in, not in each.
    """

    def kept(rows: pa.Table) -> np.ndarray:
        key, (n, group, side) = rows.column("key")[0].as_py(), (rows.column(c).to_numpy() for c in ("n", "group", "side"))
        halves = rows.column("i")[0] != rows.column("j")[0]
        known = np.full((len(rows), KNOWN), key, np.int64)
        for i, keys in enumerate(rows.column("known").to_pylist()):
            known[i, : len(keys)] = keys
        earlier = known < key
        out = np.zeros(len(rows), bool)
        maps = {signs.shape[1]: (at, signs) for at, signs in _by_size(rows.column("bits").combine_chunks())}
        for size, (x, left) in maps.items():
            for other in (size, 2 * size):
                if other not in maps:
                    continue
                y, right = maps[other]
                right = _folded(right, size)
                for a in range(0, len(x), step := max(16, (1 << 20) // len(y))):
                    rows_, differ = x[a : a + step], (size - left[a : a + step] @ right.T) / 2
                    good = (differ <= _allowed(n[rows_, None], n[None, y], percent)) & (group[rows_, None] != group[None, y])
                    if halves:
                        good &= side[rows_, None] != side[None, y]
                    p, q = np.nonzero(good)
                    p, q = rows_[p], y[q]
                    for b in range(0, len(p), 1 << 16):
                        u, v = p[b : b + (1 << 16)], q[b : b + (1 << 16)]
                        met = ((known[u][:, :, None] == known[v][:, None, :]) & earlier[u][:, :, None]).any((1, 2))
                        out[u[~met]] = out[v[~met]] = True
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, "key", "i", "j"):
            if (mask := kept(rows)).any():
                yield from rows.select(["key", "i", "j", "side", "id", "group"]).filter(pa.array(mask)).combine_chunks().to_batches()

    return run


def _shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each two sets, by products of the 0-1 matrix of the elements that more than one has."""
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, number, count = np.unique(flat, return_inverse=True, return_counts=True)
    common = count > 1
    number, owner = (np.cumsum(common) - 1)[number[at := common[number]]], owner[at]
    order = np.argsort(number, kind="stable")
    number, owner = number[order], owner[order]
    out, width = np.zeros((len(sets), len(sets)), np.float32), max(64, (1 << 21) // len(sets))
    for first in range(0, int(common.sum()), width):
        a, b = np.searchsorted(number, [first, first + width])
        block = np.zeros((len(sets), width), np.float32)
        block[owner[a:b], number[a:b] - first] = 1
        out += block @ block.T
    return out.astype(np.int64)


def _tile_links(percent: int) -> Callable:
    """A spanning forest of the links between components in each tile, on the whole sets."""

    def links(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids, group, side = (rows.column(c).to_numpy() for c in ("id", "group", "side"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for chunk in rows.column("hashes").chunks for x in chunk]
        size, shared = np.array([len(s) for s in sets]), _shared_counts(sets)
        near = 100 * shared >= percent * (size[:, None] + size[None, :] - shared)
        if rows.column("i")[0] != rows.column("j")[0]:
            near &= side[:, None] != side[None, :]
        names, label = np.unique(group, return_inverse=True)
        parent, a, b = np.arange(len(names)), [], []
        while (found := np.flatnonzero((near := near & (label[:, None] != label[None, :])).any(1))).size:
            for x, y in zip(found.tolist(), near[found].argmax(1).tolist(), strict=True):
                u, v = label[x], label[y]
                while parent[u] != u:
                    u = parent[u]
                while parent[v] != v:
                    v = parent[v]
                if u != v:
                    parent[max(u, v)] = min(u, v)
                    a.append(ids[x])
                    b.append(ids[y])
            while (parent[parent] != parent).any():
                parent = parent[parent]
            label = parent[label]
        return np.array(a, np.int64), np.array(b, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, "key", "i", "j"):
            a, b = links(rows)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


def _pick(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Documents by a list of ids: broadcast up to a limit, else joined by a shuffle."""
    ids = ids.select(F.col(ids.columns[0]).alias("doc_id"))
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "doc_id", how)


def _sets_of(ids: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """``id`` and ``hashes`` of the documents with these ids."""
    return materialize(_pick(docs, materialize(ids.distinct(), "members"), "left_semi").mapInArrow(_sets(k), "id long, hashes binary"), "hashes")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets are similar."""
    side = lambda column, name: sets.select(F.col("id").alias(column), F.col("hashes").alias(name))
    both = pairs.join(side("a", "left"), "a").join(side("b", "right"), "b").select("a", "b", "left", "right")
    return materialize(both.mapInArrow(_verify(percent), "a long, b long"), "links")


def _list_links(open_: DataFrame, groups: DataFrame, maps: DataFrame, docs: DataFrame, k: int, percent: int, parts: int) -> DataFrame:
    """Links between components that meet in the lists ``open_`` (``key``, ``n``, ``id``): enough to join all that are linked there.

    What leaves a list is linear in its entries: the members that have a partner, by
    their bitmaps, and of these, compared on their whole sets, a spanning forest.
    """
    own = groups.select(F.col("node").alias("id"), F.col("component").alias("group"))
    member = open_.join(own, "id", "left").withColumn("group", F.coalesce("group", "id"))
    tiles = materialize(_tiles(member), "tiles")
    known = tiles.select("id", "key").distinct().groupBy("id").agg(F.slice(F.array_sort(F.collect_list("key")), 1, KNOWN).alias("known"))
    dealt = lambda rows: rows.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "id")
    rows = tiles.join(known, "id").join(maps.select("id", "n", "bits"), "id")
    rows = materialize(dealt(rows).mapInArrow(_partnered(percent), "key long, i int, j int, side int, id long, group long"), "partnered", SHORT_ROWS)
    sets = _sets_of(rows.select("id"), docs, k)
    links = materialize(dealt(rows.join(sets, "id")).mapInArrow(_tile_links(percent), "a long, b long"), "links")
    forget(tiles, rows, sets)
    return links


def jaccard_groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per document: ``doc_id``, ``n_shingles`` and ``component_id``.

    Documents link when 100 * intersection >= percent * union of their sets of distinct
    k-word shingles (words: runs of anything but ASCII white space, A-Z in lower case;
    with fewer words, the whole sequence is the one shingle).  ``component_id`` is the
    smallest id reachable over links.  Null, empty or blank texts have no shingle, link
    with nothing and are their own component.  Rows that share an id are one node of the
    graph, with a row each; a null id gets the component of an equal set, or null.
    Other columns are ignored; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    told = materialize(docs.mapInArrow(_keys(k), "doc_id long, n long, k1 long, k2 long, cell long"), "keys")
    cells = told.filter("cell is not null").groupBy("cell").agg(F.sum("n").alias("n")).filter("n >= 16")
    sketch = np.zeros(1 << SKETCH_BITS, np.uint8)
    for part in cells.select("cell", F.floor(F.log2("n")).cast("int").alias("level")).toArrow().to_batches():  # 2**SKETCH_BITS rows at most
        sketch[part.column("cell").to_numpy()] = part.column("level").to_numpy()
    shipped = spark.sparkContext.broadcast(sketch)

    keys = told.filter("cell is null")
    classes = materialize(keys.filter("n > 0").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes").filter("rep is not null")
    sizes = {r[0]: r[1] for r in classes.filter(F.col("n") <= LIGHT_MOST).groupBy("n").count().collect()}
    light = boundary(sizes, percent)
    copies = keys.filter("n > 0 and doc_id is not null").join(classes.filter("copies > 1"), ["n", "k1", "k2"]).filter("doc_id != rep")
    copies = materialize(copies.select("doc_id", "rep").distinct(), "copies")
    # ids that have another row: it enters the lists, and the id links the sets of its rows
    others = classes.select(F.col("rep").alias("doc_id")).union(keys.filter("n = 0 and doc_id is not null").select("doc_id"))
    mixed = copies.groupBy("doc_id").agg((F.min("rep") != F.max("rep")).alias("ties")).join(others.distinct().withColumn("own", F.lit(True)), "doc_id", "left")
    mixed = materialize(mixed, "mixed")
    ties = copies.join(mixed.filter("ties or own"), "doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    firsts = _pick(docs.filter("doc_id is not null"), mixed.filter("own is null").select("doc_id"), "left_anti")
    entries = firsts.mapInArrow(_entries(k, percent, light, shipped), ENTRY)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    entries = entries.repartition(parts, "key", "salt").sortWithinPartitions("key", "salt", "n", "id")
    found = materialize(entries.mapInArrow(_scan(percent), FOUND), "found", SHORT_ROWS)

    pairs = found.filter(F.col("kind") == PAIR).filter("a != b").select("a", "b").distinct()
    open_ = found.filter(F.col("kind") == OPEN).select("key", "n", F.col("a").alias("id")).distinct()
    pairs = materialize(pairs, "pairs")
    open_ = materialize(open_, "open")
    members = materialize(pairs.select("a").union(pairs.select("b")).union(open_.select("id")).distinct(), "members")
    maps = materialize(_pick(docs, members, "left_semi").mapInArrow(_maps(k), "id long, n int, bits binary"), "maps")
    one, other = (maps.select(F.col("id").alias(x), F.col("n").alias(f"n{i}"), F.col("bits").alias(f"bits{i}")) for i, x in ((1, "a"), (2, "b")))
    plausible = materialize(pairs.join(one, "a").join(other, "b").mapInArrow(_plausible(percent), "a long, b long").distinct(), "plausible", SHORT_ROWS)
    links = _subset_links(found.filter(F.col("kind") == SUBSET).select("key", F.col("n").alias("role"), F.col("a").alias("id")))
    # first one pair for each document, with the least partner: enough for groups of near copies
    first = materialize(plausible.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "first")
    sets = _sets_of(plausible.select("a").union(plausible.select("b")), docs, k)
    started = materialize(connected_components(links.union(_linked(first, sets, percent)).union(ties), "sets"), "groups")

    # then the other pairs, and the lists, as far as they still lie in different components
    def placed(rows: DataFrame, column: str) -> DataFrame:
        own = started.select(F.col("node").alias(column), F.col("component").alias(f"{column}_group"))
        return rows.join(own, column, "left").withColumn(f"{column}_group", F.coalesce(f"{column}_group", column))

    rest = materialize(placed(placed(plausible, "a"), "b").filter("a_group != b_group").select("a", "b"), "rest")
    links = started.select(F.col("node").alias("a"), F.col("component").alias("b")).union(_linked(rest, sets, percent)).union(_list_links(open_, started, maps, docs, k, percent, parts))
    groups = materialize(connected_components(links, "sets"), "groups")
    forget(copies, mixed, found, pairs, open_, members, maps, plausible, sets, first, started, rest)

    node = F.coalesce("rep", "doc_id")
    out = keys.join(classes.select("n", "k1", "k2", "rep"), ["n", "k1", "k2"], "left").withColumn("node", node)
    out = out.join(groups, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents (all columns) without those that link to one of smaller id, directly or over others."""
    grouped = jaccard_groups(docs, k, percent)
    gone = materialize(grouped.filter("component_id != doc_id").select("doc_id").distinct(), "gone")
    return _pick(docs, gone, "left_anti").select(*docs.columns)
