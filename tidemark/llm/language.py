"""Language identification with string kernels.

The kernel of two texts counts the byte n-grams (of lower-case letters, words between
blanks) of several orders that both contain, whatever their number: a blended-spectrum
presence kernel, normalised to length 1.  Nystroem landmarks (training texts) span the
space; kernel ridge regression fits one function per language against the rest.  As the
kernel with a landmark is linear in the presence vector, landmarks and weights fold
into one matrix, and a batch of texts is scored by one matrix product.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._shared import filled, raw_text, slices

ORDERS = (2, 3, 4)
SLOT_BITS = 17
#: ASCII letters in lower case, other bytes of letters as they are, all else a blank.
FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)
UNKNOWN = "und"
#: Cells of the presence matrix that is multiplied at a time.
BLOCK_CELLS = 4 << 20
#: Bounds of the fit: texts a language is learned from, and landmarks among them.
SAMPLE_PER_LANG, LANDMARKS_PER_LANG, RIDGE = 400, 64, 0.1


def slots(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slot and text of every n-gram of all texts; a blank stands at both ends of each."""
    n = len(bounds) - 1
    size = np.diff(bounds)
    begin = bounds[:-1] + 2 * np.arange(n)
    padded = np.full(len(raw) + 2 * n, 32, np.uint8)
    text = np.repeat(np.arange(n, dtype=np.int32), size + 2)
    inner = np.ones(len(padded), bool)
    inner[begin] = inner[begin + size + 1] = False
    padded[inner] = FOLD[raw]
    twice = np.zeros(len(padded), bool)
    twice[1:] = (padded[1:] == 32) & (padded[:-1] == 32) & (text[1:] == text[:-1])
    padded, text = padded[~twice].astype(np.uint64), text[~twice]
    found, where, code = [], [], padded
    for order in range(2, max(ORDERS) + 1):
        code = (code[:-1] << np.uint64(8)) | padded[order - 1 :]
        if order in ORDERS:
            same = text[: len(code)] == text[order - 1 :]
            mixed = (code[same] + np.uint64(order << 40)) * np.uint64(0x9E3779B97F4A7C15)
            found.append((mixed >> np.uint64(64 - SLOT_BITS)).astype(np.int32))
            where.append(text[: len(code)][same])
    return np.concatenate(found), np.concatenate(where)


class LanguageModel:
    """``columns``: slot to column of the presence vector (-1: no landmark has it)."""

    def __init__(self, langs: list[str], columns: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.langs, self.columns, self.weights, self.bias = langs, columns, weights, bias

    @staticmethod
    def presence(texts: pa.Array, columns: np.ndarray, width: int) -> np.ndarray:
        """Presence vectors of length 1 (or 0, for a text without any known n-gram)."""
        slot, text = slots(*raw_text(texts))
        out = np.zeros((len(texts), width + 1), np.float32)
        out[text, columns[slot]] = 1  # column -1 takes the rest
        out = out[:, :width]
        return out / np.sqrt(np.maximum(out.sum(1, keepdims=True), 1))

    @classmethod
    def fit(cls, texts: list[str], langs: list[str], landmarks: int = LANDMARKS_PER_LANG, ridge: float = RIDGE) -> LanguageModel:
        names = sorted(set(langs))
        place = {c: [i for i, x in enumerate(langs) if x == c] for c in names}
        marks = [i for c in names for i in place[c][:landmarks]]
        known = np.unique(np.concatenate([slots(*raw_text(pa.array([texts[i]])))[0] for i in marks]))
        columns = np.full(1 << SLOT_BITS, -1, np.int32)
        columns[known] = np.arange(len(known))
        chunks = [cls.presence(pa.array(texts[i : i + 64]), columns, len(known)) for i in range(0, len(texts), 64)]
        vectors = np.concatenate(chunks)
        base = vectors[marks]
        values, basis = np.linalg.eigh((base @ base.T).astype(np.float64))
        kept = values > 1e-6 * values[-1]
        root = basis[:, kept] / np.sqrt(values[kept])  # inverse square root of the landmarks' kernel
        mapped = (vectors @ base.T).astype(np.float64) @ root
        goal = np.where(np.array(langs)[:, None] == np.array(names), 1.0, -1.0)
        # each language weighs the same, however many texts it has
        weigh = np.sqrt(np.array([len(texts) / len(names) / len(place[c]) for c in langs]))[:, None]
        mean = (mapped * weigh**2).sum(0) / (weigh**2).sum()
        centred = mapped - mean
        gram = (centred * weigh).T @ (centred * weigh) + ridge * np.eye(centred.shape[1])
        offset = (goal * weigh**2).sum(0) / (weigh**2).sum()
        solved = np.linalg.solve(gram, (centred * weigh).T @ ((goal - offset) * weigh))
        return cls(names, columns, (base.T.astype(np.float64) @ (root @ solved)).astype(np.float32), offset - mean @ solved)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        step = max(1, BLOCK_CELLS // max(1, len(self.weights)))
        parts = [self.presence(texts[i : i + step], self.columns, len(self.weights)) @ self.weights for i in range(0, len(texts), step)]
        values = np.concatenate(parts) + self.bias
        best = values.argmax(1)
        return [self.langs[i] for i in best], np.clip((values[np.arange(len(best)), best] + 1) / 2, 0, 1)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves no rest by 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train_language(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG, landmarks: int = LANDMARKS_PER_LANG, ridge: float = RIDGE) -> LanguageModel | None:
    """Fit on at most ``per_lang`` whole texts of each language, those least by a hash of the id.

    Only rows that are not held out and have a language and a letter are learned from;
    None if there is no such row.  The draw is by a hash threshold per language (no sort,
    no shuffle of texts), about twice ``per_lang`` rows reach the driver.
    """
    rows = docs.select("doc_id", "lang", "text").filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = rows.groupBy("lang").agg(((2.0 * per_lang + 20) / F.count("*")).alias("share"))
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    found = sorted((tuple(r) for r in rows.withColumn("h", drawn).join(F.broadcast(counts), "lang").filter("h < share").select("h", "lang", "text").collect()))
    kept: dict[str, list[str]] = {}
    for _, lang, text in found:
        if len(own := kept.setdefault(lang, [])) < per_lang:
            own.append(text)
    if not kept:
        return None
    return LanguageModel.fit([t for c in sorted(kept) for t in kept[c]], [c for c in sorted(kept) for _ in kept[c]], landmarks, ridge)


PREDICTED = T.StructType().add("doc_id", "long").add("held_out", "boolean").add("lang_pred", "string").add("score", "double")


def identify_languages(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """Per document: ``held_out``, ``lang_pred`` and ``score`` (0 to 1).

    Only the text is used.  Texts that are null or have no letter get ``und`` and score
    0, as do all if there is no model.  Repeated rows give a row each, null ids stay
    null, other columns are ignored.  No shuffle; the broadcast model is bounded by
    2**SLOT_BITS columns and the number of languages.
    """
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shipped.value
        for batch in slices(batches, "text", 1 << 20):
            texts = batch.column("text")
            known = [fitted is not None and has_letter(t) for t in texts.to_pylist()]
            langs, scores = fitted.predict(filled(texts)) if any(known) else ([UNKNOWN] * len(texts), np.zeros(len(texts)))
            langs = [c if k else UNKNOWN for c, k in zip(langs, known, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(np.where(known, scores, 0.0))], names=PREDICTED.fieldNames())

    return docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, PREDICTED)
