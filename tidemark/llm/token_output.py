"""Token-id output: frequency-ranked ids in a byte-aligned variable-length code.

A file holds whole documents in ascending id order.  Its ids are replaced by their
rank in the file's own frequency table, so common ids take one byte.  The lengths of
four codes (1 to 4 bytes each) share a control byte; control bytes and data bytes
stand apart, so numpy decodes a file with one table lookup and one masked copy.
Every file carries its table: it can be read alone, and one pass over the corpus
writes it.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._shared import KeyTable, filled, model_of, ramp, raw_text, shared_dir, slices, small_batches, span_hashes, word_spans

MAGIC = b"TMV1"
HEAD = struct.Struct("<4sIQIQI")  # magic, documents, ids, table entries, data bytes, crc32 of all behind the header
#: Byte lengths of the four codes of each control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1
#: Ids of a file, unless one document alone has more.
FILE_IDS = 2_000_000


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, "<u4")
    lens = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    padded = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    padded[: len(values)] = lens - 1
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) < lens[:, None]]
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    lens = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    out = np.zeros((n, 4), np.uint8)
    out[np.arange(4) < lens[:, None]] = np.frombuffer(data, np.uint8)
    return out.reshape(-1).view("<u4")


def encode_file(doc_ids: list[int | None], lens: np.ndarray, ids: np.ndarray) -> bytes:
    """A file's bytes: header, table (rank to id), document ids, their lengths, control, data."""
    counts = np.bincount(ids)  # ids are below the vocabulary's size
    table = np.flatnonzero(counts)
    order = np.argsort(-counts[table], kind="stable")
    rank = np.zeros(len(counts), "<u4")
    rank[table[order]] = np.arange(len(table), dtype="<u4")
    control, data = pack(rank[ids])
    known = np.array([x is not None for x in doc_ids], np.uint8)
    numbers = np.array([0 if x is None else x for x in doc_ids], "<i8")
    body = b"".join([table[order].astype("<u4").tobytes(), known.tobytes(), numbers.tobytes(), lens.astype("<u8").tobytes(), control, data])
    return HEAD.pack(MAGIC, len(doc_ids), len(ids), len(table), len(data), zlib.crc32(body)) + body


def decode_file(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, their numbers of ids, and all ids one after the other."""
    magic, docs, n, entries, size, crc = HEAD.unpack_from(raw)
    body = memoryview(raw)[HEAD.size :]
    if magic != MAGIC or zlib.crc32(body) != crc:
        raise ValueError("not a token file, or a damaged one")
    at = 0

    def take(width: int) -> memoryview:
        nonlocal at
        at += width
        return body[at - width : at]

    table = np.frombuffer(take(4 * entries), "<u4")
    known = np.frombuffer(take(docs), np.uint8)
    numbers = np.frombuffer(take(8 * docs), "<i8")
    lens = np.frombuffer(take(8 * docs), "<u8").astype(np.int64)
    ranks = unpack(take(-(-n // 4)), take(size), n)
    return [int(x) if k else None for x, k in zip(numbers, known, strict=True)], lens, table[ranks] if n else ranks


#: The split of the tokenizers whose texts may be folded before (see WordEncoder).
FOLDABLE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
LETTER = np.array([chr(c).isalnum() and c < 128 for c in range(256)])
SIGN = np.array([c in b",.;:!?|*$%&#)\"" for c in range(256)])


class WordEncoder:
    """Ids of whole texts for a tokenizer that never joins across ASCII white space.

    Words are told apart by 64-bit hashes, many at once; only words that were not met
    before go through the tokenizers library, many to a call, with a mark between them.
    What is known is dropped when it is too much.  If the tokenizer itself lowers case
    and parts letters from signs, ASCII letters are lowered and signs behind letters set
    apart first, which changes no id and leaves fewer words; texts with strings that
    look like special tokens are left as they are.
    """

    MARK = "~"
    BLANK = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])

    def __init__(self, path: str, limit: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        steps = [json.loads(x.__getstate__()) if x else {} for x in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer)]
        self.folds = any(x["type"] == "Lowercase" for x in steps[0].get("normalizers", [])) and any(
            x.get("pattern") == {"Regex": FOLDABLE} and x.get("invert") for x in steps[1].get("pretokenizers", [])
        )
        mark = self.tokenizer.encode(self.MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self._clear()

    def _clear(self) -> None:
        self.known = KeyTable()
        self.flat, self.starts, self.lens = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        joins = np.array([self.mark is not None and self.MARK not in w and "<" not in w for w in words], bool)
        plain, other = [w for w, j in zip(words, joins, strict=True) if j], [w for w, j in zip(words, joins, strict=True) if not j]
        joined = [f" {self.MARK} ".join([*plain[i : i + 256], ""]) for i in range(0, len(plain), 256)]
        found = [x for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False) for x in e.ids]
        flat = np.fromiter(found, np.uint32, len(found))
        ends = np.flatnonzero(flat == self.mark) if plain else np.zeros(0, np.int64)
        lens = np.diff(ends, prepend=-1) - 1
        flat = np.delete(flat, ends)
        if other:
            rest = [e.ids for e in self.tokenizer.encode_batch_fast(other, add_special_tokens=False)]
            lens = np.concatenate([lens, np.fromiter(map(len, rest), np.int64, len(rest))])
            flat = np.concatenate([flat, np.array([x for ids in rest for x in ids], np.uint32)])
        self.known.add(np.concatenate([keys[joins], keys[~joins]]))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lens) - lens])
        self.lens, self.flat = np.concatenate([self.lens, lens.astype(np.int32)]), np.concatenate([self.flat, flat])

    def _folded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw, bounds = raw_text(texts)
        if not self.folds:
            return raw, bounds
        special = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False).astype(bool)
        low = LOWER[raw]
        cut = LETTER[low[:-1]] & SIGN[low[1:]]
        if special.any():
            inside = np.repeat(special, np.diff(bounds))
            low[inside] = raw[inside]
            cut &= ~inside[1:]
        at = np.flatnonzero(cut) + 1
        return np.insert(low, at, 32), bounds + np.searchsorted(at, bounds)

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and how many each text has."""
        if len(self.known) > self.limit or len(self.flat) > 8 * self.limit:
            self._clear()
        raw, bounds = self._folded(texts)
        begin, end, firsts = word_spans(raw, bounds, self.BLANK)
        keys = span_hashes(raw, begin, end)
        place = self.known.find(keys)
        if len(new := np.flatnonzero(place < 0)):
            fresh, at = np.unique(keys[new], return_index=True)
            at = new[at]
            whole = raw.tobytes()
            self._learn(fresh, [whole[a:b].decode() for a, b in zip(begin[at].tolist(), end[at].tolist(), strict=True)])
            place[new] = self.known.find(keys[new])
        lens = self.lens[place].astype(np.int64)
        sums = np.concatenate([[0], np.cumsum(lens)])
        counts = np.diff(sums[firsts])
        ids = self.flat[ramp(self.starts[place], lens)]
        if end_id is None:
            return ids, counts
        return np.insert(ids, np.cumsum(counts), end_id).astype(np.uint32), counts + 1


def _writer(path: str, end_id: int | None, folder: str, file_ids: int) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        part, block, rows, count = TaskContext.get().partitionId(), 0, [], 0
        pending, own = [], model_of("encoder", WordEncoder, path)

        def flush() -> None:
            nonlocal block, pending, count
            lens, ids = np.concatenate([x[1] for x in pending]), np.concatenate([x[2] for x in pending])
            raw = encode_file([i for x in pending for i in x[0]], lens, ids)
            store, root = fs.FileSystem.from_uri(folder)
            name = f"{root}/part-{part:06d}-{block:06d}.tmv"
            draft = f"{name}.{TaskContext.get().taskAttemptId()}"
            with store.open_output_stream(draft) as out:
                out.write(raw)
            if store.get_file_info(name).type != fs.FileType.NotFound:  # of an attempt that was lost; not every store moves onto a file
                store.delete_file(name)
            store.move(draft, name)  # the same rows give the same bytes, so a repeated task replaces its own file
            rows.append((part, block, f"{folder}/{os.path.basename(name)}", len(lens), len(ids)))
            block, pending, count = block + 1, [], 0

        for batch in slices(batches, "text", 1 << 20, "encoder"):
            ids, counts = own.encode(filled(batch.column("text")), end_id)
            pending.append((batch.column("doc_id").to_pylist(), counts, ids))
            count += len(ids)
            if count >= file_ids:
                flush()
        if pending:
            flush()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["part", "block", "path", "n_docs", "n_tokens"])

    return write


MANIFEST = T.StructType().add("part", "long").add("block", "long").add("path", "string").add("n_docs", "long").add("n_tokens", "long")


def write_tokens(docs: DataFrame, path: str, end_id: int | None = 2, folder: str | None = None, file_ids: int = FILE_IDS) -> DataFrame:
    """Write the ids of all texts in ascending ``doc_id`` order; returns the manifest.

    ``path`` is the tokenizer's file, ``folder`` a URI that all executors reach (a new
    one in the shared folder by default).  Null texts count as empty; null ids come
    first; rows with one id follow their text; columns other than ``doc_id`` and
    ``text`` are ignored; an empty table writes no file.  The manifest (one row per
    file: part, block, path, n_docs, n_tokens) stands beside the files as Parquet.
    """
    spark = docs.sparkSession
    folder = folder or shared_dir(spark, "tokens")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(place)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select("doc_id", "text").repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    files = dealt.mapInArrow(_writer(path, end_id, folder, file_ids), MANIFEST)
    with small_batches(spark):
        files.write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


DIGEST = T.StructType().add("doc_id", "long").add("start", "long").add("n_tokens", "long").add("ids_crc32", "long")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
            store, name = fs.FileSystem.from_uri(path)
            with store.open_input_stream(name) as file:
                doc_ids, lens, ids = decode_file(file.read())
            ends = np.cumsum(lens)
            raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
            crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lens.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64()), pa.array(start + ends - lens), pa.array(lens), pa.array(crc, pa.int64())], names=DIGEST.fieldNames()
            )


def read_digest(manifest: DataFrame) -> DataFrame:
    """Decode all files: per document its id, start, number of ids and their crc32.

    Starts come from sums in two steps: over the parts on the driver (a number each),
    then over the files of a part.
    """
    spark = manifest.sparkSession
    sums = sorted((r[0], r[1]) for r in manifest.groupBy("part").agg(F.sum("n_tokens")).collect())
    before, at = [], 0
    for part, n in sums:
        before.append((part, at))
        at += n
    offsets = spark.createDataFrame(before, "part long, part_start long")
    within = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.join(offsets, "part").withColumn("start", F.col("part_start") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    n = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), manifest.count()))
    return files.select("path", "start").repartition(n, "path").mapInArrow(_read, DIGEST)
