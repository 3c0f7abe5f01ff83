"""Exact token counts at every prefix of a text, by dynamic programming.

A byte-pair encoding is valid exactly when each two neighbouring pieces are what the
two encode to when joined.  So the last piece of the encoding of every prefix is the
one piece that ends there and fits the last piece of the prefix before it, and the
count is that prefix's count plus one: a pass from left to right gives the counts of
all prefixes.  Where two characters stand side by side in no piece of the model, no
piece reaches across: texts fall into units there, whose counts add up.  Units repeat,
and their results are kept under a 64-bit hash.  Counts are stored as differences of a byte each, and answer budgets and
truncation without encoding anything again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._shared import KeyTable, filled, model_of, ramp, raw_text, slices, span_hashes

SPACE = "▁"
#: Prefixes up to this length are looked up.
KEPT_CHARS = 32


class PrefixCounter:
    """Counts of a sentencepiece BPE model with byte fallback and no normalisation."""

    def __init__(self, path: str, limit: int = 200_000):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        special = lambda i: model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
        self.scores = {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if not special(i)}
        self.longest = max(map(len, self.scores))
        self.pairs: dict[tuple[str, str], bool] = {}
        self.limit = limit
        # pairs of bytes that no piece joins: neither character by character, nor beside characters above ASCII
        joined = {a + b for p in self.scores for a, b in zip(p, p[1:], strict=False)}
        self.barrier = np.zeros((256, 256), bool)
        for a in range(128):
            left = SPACE if a == 32 else chr(a)
            self.barrier[a, :128] = [left + (SPACE if b == 32 else chr(b)) not in joined for b in range(128)]
            self.barrier[a, 0xC0:] = not any(x[0] == left and x[1] > "\x7f" and x[1] != SPACE for x in joined)
            self.barrier[0x80:, a] = not any(x[1] == left and x[0] > "\x7f" and x[0] != SPACE for x in joined)
        self._clear()

    def _clear(self) -> None:
        self.known = KeyTable()
        self.prefixes: dict[str, tuple[str, int]] = {}
        self.flat, self.starts = np.zeros(0, np.int8), np.zeros(0, np.int64)
        self.lens, self.sums = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text, by merging the best pair again and again."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            found = [(scores[p], -i) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in scores]
            if not found:
                break
            i = -max(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def fits(self, left: str, right: str) -> bool:
        if (found := self.pairs.get((left, right))) is None:
            if len(self.pairs) > 2 * self.limit:
                self.pairs.clear()
            found = self.pairs[left, right] = self.merged(left + right) == ([left, right] if left else [right])
        return found

    def counts(self, unit: str) -> list[int]:
        """Tokens of unit[:1], unit[:2], ...  Prefixes met before are looked up."""
        last, count, scores, done = [""], [0], self.scores, self.prefixes
        if len(done) > 2 * self.limit:
            done.clear()
        for end in range(1, len(unit) + 1):
            head = unit[:end] if end <= KEPT_CHARS else None  # longer prefixes aren't kept: looking them up would take the square of the unit's length
            if (found := done.get(head)) is None:
                if unit[end - 1] not in scores:  # its bytes are tokens, and nothing joins them
                    found = "", count[-1] + len(unit[end - 1].encode("utf-8", "surrogatepass"))
                else:
                    for start in range(max(0, end - self.longest), end):
                        if (piece := unit[start:end]) in scores and self.fits(last[start], piece):
                            found = piece, count[start] + 1
                            break
                    else:
                        raise ValueError(f"no piece of the model ends {unit[max(0, end - 32) : end]!r}")
                if head is not None:
                    done[head] = found
            last.append(found[0])
            count.append(found[1])
        return count[1:]

    def _learn(self, keys: np.ndarray, units: list[str]) -> None:
        found = [self.counts(u) for u in units]
        lens = np.fromiter(map(len, found), np.int64, len(found))
        begin = np.cumsum(lens) - lens
        flat = np.diff(np.fromiter((x for counts in found for x in counts), np.int64, int(lens.sum())), prepend=0)
        flat[begin[1:]] = [counts[0] for counts in found[1:]]
        if len(flat) and (flat.min() < -128 or flat.max() > 127):
            raise OverflowError("counts of neighbouring prefixes differ by more than a byte holds")
        self.known.add(keys)
        self.starts = np.concatenate([self.starts, len(self.flat) + begin])
        self.lens, self.flat = np.concatenate([self.lens, lens.astype(np.int32)]), np.concatenate([self.flat, flat.astype(np.int8)])
        self.sums = np.concatenate([self.sums, np.fromiter((counts[-1] for counts in found), np.int32, len(found))])

    def units(self, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Begins of the units of all texts: where no piece of the model reaches across."""
        cut = self.barrier[raw[:-1], raw[1:]]
        first = np.zeros(len(raw) + 1, bool)
        first[bounds] = True
        first[1:-1] |= cut
        return np.flatnonzero(first[:-1])

    def deltas(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Differences of the counts of all prefixes (a byte per character), the texts' boundaries in them, their counts."""
        if len(self.known) > 4 * self.limit or len(self.flat) > 64 * self.limit:
            self._clear()
        raw, bounds = raw_text(pc.replace_substring(texts, SPACE, " "))
        full = np.flatnonzero(np.diff(bounds))
        raw = np.insert(raw, bounds[full], 32)  # a space mark goes before every text that isn't empty
        shift = np.zeros(len(bounds), np.int64)
        shift[full + 1] = 1
        bounds = bounds + np.cumsum(shift)
        if not len(raw):
            return np.zeros(0, np.int8), bounds, np.diff(bounds)
        begin = self.units(raw, bounds)
        end = np.append(begin[1:], len(raw))
        keys = span_hashes(raw, begin, end)
        place = self.known.find(keys)
        if len(new := np.flatnonzero(place < 0)):
            fresh, at = np.unique(keys[new], return_index=True)
            at = new[at]
            whole = raw.tobytes()
            self._learn(fresh, [whole[a:b].decode().replace(" ", SPACE) for a, b in zip(begin[at].tolist(), end[at].tolist(), strict=True)])
            place[new] = self.known.find(keys[new])
        lens = self.lens[place].astype(np.int64)
        firsts = np.searchsorted(begin, bounds)
        counts = np.diff(np.concatenate([[0], np.cumsum(self.sums[place], dtype=np.int64)])[firsts])
        flat = self.flat[ramp(self.starts[place], lens)]
        chars = np.concatenate([[0], np.cumsum(lens)])[firsts]
        first = chars[:-1][full]  # the leading space mark belongs to no character of the text
        flat[first + 1] += flat[first]
        bounds = np.concatenate([[0], np.cumsum(np.maximum(np.diff(chars) - 1, 0))])
        return np.delete(flat, first), bounds, counts


def prefix_counts(deltas: bytes) -> np.ndarray:
    """Counts of the prefixes of 0, 1, ... characters, from the stored differences."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(deltas, np.int8), dtype=np.int64)])


def longest_prefix(deltas: bytes, budget: int) -> int:
    """Characters of the longest prefix that has ``budget`` tokens at most."""
    return int(np.flatnonzero(prefix_counts(deltas) <= budget)[-1])


COUNTS = T.StructType().add("doc_id", "long").add("n_bytes", "long").add("n_tokens", "long").add("fits_chars", "long").add("prefix_deltas", "binary")


def _counter(path: str, budget: int) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = model_of("counter", PrefixCounter, path)
        for batch in slices(batches, "text", 1 << 20, "counter"):
            texts = filled(batch.column("text"))
            flat, bounds, counts = counter.deltas(texts)
            size = np.diff(raw_text(texts)[1])
            fits = np.diff(bounds)
            for i in np.flatnonzero(counts > budget):
                fits[i] = longest_prefix(flat[bounds[i] : bounds[i + 1]].tobytes(), budget)
            stored = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(size), pa.array(counts), pa.array(fits), stored], names=COUNTS.fieldNames())

    return count


def count_tokens(docs: DataFrame, path: str, budget: int = 4096) -> DataFrame:
    """Per document: ``n_bytes`` (UTF-8), ``n_tokens``, ``fits_chars`` (characters of the
    longest prefix within ``budget`` tokens) and ``prefix_deltas`` (see prefix_counts).

    Null texts count as empty (no token); null ids stay null; repeated rows give a row
    each; other columns are ignored; an empty table gives an empty table.  No shuffle.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_counter(path, budget), COUNTS)
