"""Fuzzy search for short licence notices in whole texts.

A text becomes its lower-case words, joined by single spaces.  A notice that occurs
with at most k edits contains one of its k + 1 parts unchanged (pigeonhole): an
Aho-Corasick automaton finds all parts of all notices in one pass, and the regex
library's bounded-error matching verifies a window around each hit and gives the span.
The words that tell one licence from another must stand in the match as they are.
Phrases (no edits) are searched in the same pass; their single part is the phrase.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._shared import slices

#: Phrases that count where their words stand consecutively, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Short notices that are searched with edits, and their labels.
NOTICES = {
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "licensed under the isc license": "isc",
    "licensed under the boost software license": "bsl",
    "licensed under the eclipse public license": "epl",
    "licensed under the european union public licence": "eupl",
    "licensed under the zlib license": "zlib",
    "licensed under the artistic license": "artistic",
    "licensed under the sil open font license": "ofl",
    "common development and distribution license": "cddl",
    "released into the public domain": "public-domain",
    "licensed under the apache license version": "apache",
    "redistribution and use in source and binary forms": "bsd",
    "licensed under the bsd license": "bsd",
    "licensed under the gnu general public license": "gpl",
    "licensed under the gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "subject to the terms of the mozilla public license": "mpl",
    "licensed under cc by nc": "cc-by-nc",
    "licensed under cc by sa": "cc-by-sa",
    "licensed under cc by nd": "cc-by-nd",
    "creative commons attribution": "cc",
    "dedicated to the public domain": "public-domain",
    "all rights are reserved": "reserved",
    "no part of this work may be reproduced": "reserved",
}
#: Words of the notices that tell licences apart: edits may not fall in them.
TELLING = frozenset("mit isc boost eclipse european zlib artistic sil cddl apache bsd gnu lesser affero mozilla nc sa nd attribution public domain".split())
#: Letters of a notice for each edit that it allows.
LETTERS_PER_EDIT = 12
#: ASCII upper-case letters fall to lower case; all ASCII but letters and digits separates words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def normalize(text: str | None) -> str:
    """The words of a text, lower-case, each between single spaces; a blank at both ends."""
    words = (text or "").encode("utf-8", "replace").translate(FOLD).split(b" ")
    return f" {b' '.join(filter(None, words)).decode()} "


def parts(notice: str, edits: int) -> list[tuple[int, str]]:
    """edits + 1 parts that cover the notice, with their places."""
    n, k = len(notice), edits + 1
    cut = [i * n // k for i in range(k + 1)]
    return [(a, notice[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


class Scanner:
    def __init__(self, phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None, letters_per_edit: int = LETTERS_PER_EDIT):
        self.phrases = PHRASES if phrases is None else phrases
        self.notices = NOTICES if notices is None else notices
        self.edits = {n: len(n) // letters_per_edit for n in self.notices}
        self.telling = {n: [w for w in n.split() if w in TELLING] for n in self.notices}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("automaton", "patterns")}

    @cached_property
    def automaton(self):
        import ahocorasick

        seeds: dict[str, list[tuple[str, int, bool]]] = {}
        for phrase in self.phrases:
            seeds.setdefault(f" {phrase} ", []).append((phrase, 0, True))
        for notice, edits in self.edits.items():
            for at, part in parts(notice, edits):
                seeds.setdefault(part, []).append((notice, at, False))
        out = ahocorasick.Automaton()
        for seed, owners in seeds.items():
            out.add_word(seed, (len(seed), tuple(owners)))
        out.make_automaton()
        return out

    @cached_property
    def patterns(self) -> dict:
        import regex

        return {n: regex.compile(f"(?b)(?:{regex.escape(n, literal_spaces=True)}){{e<={e}}}") for n, e in self.edits.items()}

    def scan(self, words: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str, int, str]]]:
        """Of normalized words: the phrases' places, then the notices' (begin, end, label, edits, notice)."""
        exact, windows = [], set()
        for last, (size, owners) in self.automaton.iter(words):
            begin = last + 1 - size
            for owner, at, phrase in owners:
                if phrase:
                    exact.append((begin + 1, last, self.phrases[owner]))
                else:
                    edits = self.edits[owner]
                    windows.add((max(0, begin - at - edits), min(len(words), begin - at + len(owner) + edits), owner))
        # a window holds one occurrence of its notice: that around its seed
        fuzzy = set()
        for low, high, notice in windows:
            if high - low >= len(notice) - self.edits[notice] and (m := self.patterns[notice].search(words, low, high)):
                if set(self.telling[notice]) <= set(words[words.rfind(" ", 0, m.start() + 1) + 1 : words.find(" ", m.end() - 1)].split()):
                    fuzzy.add((m.start(), m.end(), self.notices[notice], sum(m.fuzzy_counts), notice))
        kept: list = []  # of matches that overlap, those with the fewest edits; of one notice, the first of them
        most = max((m[1] - m[0] for m in fuzzy), default=0)
        for m in sorted(fuzzy, key=lambda m: (m[3], m)):
            near = kept[bisect_left(kept, (m[0] - most,)) : bisect_left(kept, (m[1],))]
            if not any(m[0] < k[1] and (k[3] < m[3] or k[4] == m[4]) for k in near):
                insort(kept, m)
        return exact, kept


SPAN = T.StructType().add("first_word", "long").add("last_word", "long").add("label", "string").add("edits", "integer").add("notice", "string")
SCAN = (
    T.StructType().add("doc_id", "long").add("n_words", "long").add("n_base", "long").add("first_word", "long").add("last_word", "long")
    .add("base_labels", "string").add("labels", "string").add("score", "double").add("spans", T.ArrayType(SPAN))
)


def _scan(scanner: Scanner) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(SCAN)
        for batch in slices(batches, "text", 1 << 20):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = normalize(text)
                n = 0 if len(words) == 2 else words.count(" ") - 1
                exact, fuzzy = scanner.scan(words)
                blanks = np.flatnonzero(np.frombuffer(words.encode("utf-32-le"), "<u4") == 32)
                word_at = lambda places: (np.searchsorted(blanks, np.array(places, np.int64)) - 1).clip(0).tolist()  # noqa: E731  the word that holds a place, or begins behind the blank there
                at = word_at([begin for begin, _, _ in exact])
                base = {label for _, _, label in exact}
                score = max([1.0 if exact else 0.0, *(1 - edits / len(notice) for *_, edits, notice in fuzzy)])
                begins, ends = word_at([a + 1 for a, *_ in fuzzy]), word_at([b - 1 for _, b, *_ in fuzzy])
                spans = [{"first_word": i, "last_word": j, "label": label, "edits": edits, "notice": notice} for i, j, (_, _, label, edits, notice) in zip(begins, ends, fuzzy, strict=True)]
                rows.append({
                    "doc_id": doc_id, "n_words": n, "n_base": len(at), "first_word": min(at, default=None), "last_word": max(at, default=None),
                    "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | {x[2] for x in fuzzy})), "score": score, "spans": spans,
                })
            yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def scan_licenses(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """Per document: ``n_words``, ``n_base`` (places of phrases), ``first_word`` and
    ``last_word`` (their smallest and largest start), ``base_labels``, ``labels``,
    ``score`` (1 less the share of edits of the best match, 0 without one) and ``spans``
    (words, label, edits and notice of each fuzzy match).

    Null or empty text has no words, no labels and score 0; null ids stay null; repeated
    rows give a row each; other columns are ignored.  No shuffle.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scan(scanner or Scanner()), SCAN)
