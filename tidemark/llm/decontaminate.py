"""Benchmark decontamination by greedy string tiling.

Runs of shared words between a document and a benchmark item become tiles: the longest
match of unmarked words is marked first, then the next, until none of the least length
is left (running Karp-Rabin).  Order doesn't matter, so reordered passages are found.
The share of the item's words under tiles decides.

Every tile is made of shared seeds (windows of the least length), so documents are
joined to items by seed hashes first, and only pairs whose seeds could cover enough are
tiled.  Items come in shards of bounded size, a pass over the documents each; documents
are never shuffled.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._shared import filled, materialize, raw_text, shingle_hashes, slices, word_hashes

TILE, COVERED = 4, 0.6
#: Bytes of benchmark text that one pass broadcasts.
SHARD_BYTES = 16 << 20
#: Words are runs of ASCII letters and digits and of all other characters above ASCII, in lower case; characters of scripts without blanks are words by themselves.
BETWEEN = np.array([not (48 <= c <= 57 or 97 <= c <= 122 or c >= 128) for c in range(256)])
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)

#: First two UTF-8 bytes of scripts without blanks: Thai, Lao, Myanmar, Khmer, kana and Chinese characters.
ALONE = np.zeros(1 << 16, bool)
for _first, _last in ((0xE0B8, 0xE0BB), (0xE180, 0xE182), (0xE19E, 0xE19F), (0xE380, 0xE383), (0xE390, 0xE3BF), (0xE480, 0xE4BF), (0xE580, 0xE9BF), (0xEFA4, 0xEFAB), (0xF0A0, 0xF0BF)):
    ALONE[_first : _last + 1] = True


def _apart(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with blanks around the characters that are words by themselves."""
    at = np.flatnonzero(raw[:-1] >= 0xE0)
    at = at[ALONE[raw[at].astype(np.int64) << 8 | raw[at + 1]]]
    if not len(at):
        return raw, bounds
    places = np.sort(np.concatenate([at, at + 3 + (raw[at] >= 0xF0)]))
    moved = bounds + np.searchsorted(places, bounds, "left")
    moved[-1] += len(places) - np.searchsorted(places, bounds[-1], "left")
    return np.insert(raw, places, 32), moved


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, bounds = raw_text(texts)
    low = LOWER[raw]
    latin = np.flatnonzero((low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)) + 1
    low[latin] += 32  # capital letters with accents
    return word_hashes(*_apart(low, bounds), BETWEEN)


def tiles(item: list[int], text: list[int], least: int = TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in item, place in text, length), no word used twice."""
    found: list[tuple[int, int, int]] = []
    used, taken = [False] * len(item), [False] * len(text)
    length = max(least, min(len(item), len(text)) // 2)
    while True:
        matches, longest = _matches(item, text, used, taken, length)
        if longest > 2 * length:  # much longer than searched for: start again from there
            length = longest
            continue
        for size, a, b in sorted(matches, key=lambda m: (-m[0], m[1], m[2])):
            if any(used[a : a + size]) or any(taken[b : b + size]):
                # what an earlier tile left of this match is found in a later round
                continue
            used[a : a + size] = taken[b : b + size] = [True] * size
            found.append((a, b, size))
        if length > least and not _blocked(matches, used, taken, length):
            length = max(least, length // 2)
        elif not matches:
            return sorted(found)


def _blocked(matches: list, used: list[bool], taken: list[bool], length: int) -> bool:
    """Whether a match that an earlier tile cut still has a free part of this length."""
    for size, a, b in matches:
        run = 0
        for k in range(size):
            run = 0 if used[a + k] or taken[b + k] else run + 1
            if run >= length:
                return True
    return False


def _matches(item: list[int], text: list[int], used: list[bool], taken: list[bool], length: int) -> tuple[list, int]:
    """Maximal matches of unmarked words that are at least ``length`` long, from rolling hashes."""
    place = defaultdict(list)
    for at, h in _rolling(item, used, length):
        place[h].append(at)
    out, longest, seen = [], 0, set()
    for b, h in _rolling(text, taken, length):
        for a in place.get(h, ()):
            if (a - b, b) in seen:
                continue
            size = 0
            while a + size < len(item) and b + size < len(text) and item[a + size] == text[b + size] and not used[a + size] and not taken[b + size]:
                size += 1
                seen.add((a - b, b + size))
            if size >= length:
                out.append((size, a, b))
                longest = max(longest, size)
                if longest > 2 * length:
                    return out, longest
    return out, longest


def _rolling(words: list[int], marked: list[bool], length: int, base: int = 0x100000001B3, modulus: int = (1 << 61) - 1) -> Iterator[tuple[int, int]]:
    """Karp-Rabin hashes of all windows without a marked word."""
    top, run, h = pow(base, length, modulus), 0, 0
    for i, word in enumerate(words):
        if marked[i]:
            run = h = 0
            continue
        h = (h * base + word) % modulus
        run += 1
        if run > length:
            h = (h - words[i - length] * top) % modulus
        if run >= length:
            yield i - length + 1, h


class Items:
    """A shard of the benchmark: words and seeds."""

    FILTER_BITS = 20

    def __init__(self, ids: list[int], texts: list[str | None], least: int, parts: int = 1):
        self.least, self.ids, self.parts = least, ids, parts
        words, firsts = words_of(pa.array([t or "" for t in texts], pa.string()))
        self.words = [words[a:b].tolist() for a, b in zip(firsts, firsts[1:], strict=False)]
        seeds, at = shingle_hashes(words, firsts, least)
        owner = np.searchsorted(firsts, at, "right") - 1
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.owner, self.place = seeds[order], owner[order], (at - firsts[owner])[order]
        self.filter = np.zeros(1 << self.FILTER_BITS, bool)
        self.filter[self.seeds >> np.uint64(64 - self.FILTER_BITS)] = True

    def leaks(self, texts: pa.Array, covered: float) -> list[tuple[int, int, float, list[tuple[int, int, int]]]]:
        """(row, item, share of the item's words under tiles, tiles) of all pairs at or above ``covered``."""
        words, firsts = words_of(texts)
        seeds, at = shingle_hashes(words, firsts, self.least)
        maybe = np.flatnonzero(self.filter[seeds >> np.uint64(64 - self.FILTER_BITS)])
        low, high = np.searchsorted(self.seeds, seeds[maybe], "left"), np.searchsorted(self.seeds, seeds[maybe], "right")
        shared: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for i, a, b in zip(maybe[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
            row = int(np.searchsorted(firsts, at[i], "right")) - 1
            for j in range(a, b):
                shared[row, int(self.owner[j])].append((int(at[i]), int(self.place[j])))
        out = []
        for (row, item), pairs in sorted(shared.items()):
            mine, goal = self.words[item], covered * len(self.words[item])
            if len({p + k for _, p in pairs for k in range(self.least)}) < goal:
                continue
            inside = np.unique(np.array([a for a, _ in pairs])[:, None] + np.arange(self.least))
            # the document's words outside shared seeds can't be in a tile: one mark for each gap
            text: list[int] = []
            where: list[int] = []
            for k, a in enumerate(inside.tolist()):
                if k and a != inside[k - 1] + 1:
                    text.append(-1)
                    where.append(-1)
                text.append(int(words[a]))
                where.append(a - int(firsts[row]))
            found = [(a, where[b], n) for a, b, n in tiles(mine, text, self.least)]
            if (share := sum(n for *_, n in found) / len(mine)) >= covered:
                out.append((row, item, share, found))
        return out


def _shards(benchmark: DataFrame, least: int, limit: int) -> Iterator[Items]:
    """The benchmark in parts of at most about ``limit`` bytes, each small enough to broadcast."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)))).first()[0] or 0
    parts = max(1, math.ceil(1.2 * size / limit))
    for part in range(parts):
        own = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text").collect() if parts > 1 else rows.orderBy("item_id", "text").collect()
        yield Items([r[0] for r in own], [r[1] for r in own], least, parts)


TILES = T.ArrayType(T.StructType().add("item_word", "long").add("doc_word", "long").add("n_words", "long"))
LEAKS = T.StructType().add("doc_id", "long").add("item_id", "long").add("coverage", "double").add("n_tiles", "long").add("tiles", TILES)


def find_leaks(docs: DataFrame, benchmark: DataFrame, covered: float = COVERED, least: int = TILE, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """A row for each document and benchmark item of which tiles cover ``covered`` or more:
    ``doc_id``, ``item_id``, ``coverage``, ``n_tiles``, ``tiles`` (places and lengths in words).

    Whole texts are read.  Null or empty texts and items of fewer than ``least`` words
    match nothing; repeated documents or items give rows of their own; null ids stay
    null; other columns are ignored; empty tables give no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark, out = docs.sparkSession, None
    schema = to_arrow_schema(LEAKS)
    for items in _shards(benchmark, least, shard_bytes):
        shipped = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                ids = batch.column("doc_id")
                rows = [
                    {"doc_id": ids[row].as_py(), "item_id": shipped.value.ids[item], "coverage": share, "n_tiles": len(found), "tiles": [dict(zip(("item_word", "doc_word", "n_words"), x, strict=True)) for x in found]}
                    for row, item, share, found in shipped.value.leaks(filled(batch.column("text")), covered)
                ]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

        found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, LEAKS)
        if items.parts > 1:  # a shard at a time is broadcast
            found = materialize(found, "leaks")
            shipped.destroy()
        out = found if out is None else out.union(found)
    return out


def _keeper(shipped, covered: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            gone = {row for row, *_ in shipped.value.leaks(filled(batch.column("text")), covered)}
            yield batch.filter(pa.array([i not in gone for i in range(batch.num_rows)], pa.bool_())) if gone else batch

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, covered: float = COVERED, least: int = TILE, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The documents (all columns) that contain no benchmark item to the share ``covered``.

    Cases as in find_leaks; documents without text stay.
    """
    for items in _shards(benchmark, least, shard_bytes):
        shipped = docs.sparkSession.sparkContext.broadcast(items)
        docs = docs.mapInArrow(_keeper(shipped, covered), docs.schema)
        if items.parts > 1:
            docs = materialize(docs, "clean")
            shipped.destroy()
    return docs
