"""Quality by the perplexity of an interpolated modified Kneser-Ney n-gram model.

The model counts character n-grams (UTF-16 units, four of them in a 64-bit key, so that
contexts and suffixes are shifts and masks) of trusted text, for each language.  All
counts, continuation counts, discounts and context sums are distributed tables that
grow with the trusted text.  Scoring joins them shard by shard on the n-gram key:

1. a scan writes the documents as compressed blobs, each of a chunk of bounded size;
   from these come the counts of trusted text and the distinct n-grams of each chunk;
2. the distinct n-grams of all chunks meet the count tables in joins on the n-gram, its
   context and its suffixes, which gives each n-gram's interpolated probability;
3. every chunk gets back the probabilities of its own n-grams, next to its texts, and
   sums them per document.

Neither the model nor a corpus-wide table is ever broadcast or held in one place.  Chunks
are written once and read again, so lost executors and other splits don't move them.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._shared import KeyTable, forget, materialize, slices, small_batches, trim

ORDER, START = 4, 2
#: One in so many trusted documents isn't trained on; thresholds come from these alone.
HELD_OUT = 3
#: Text bytes of a chunk, those of a blob (one text may have more), and the blobs that Python gets at a time.
CHUNK_BYTES, BLOB_BYTES, BLOBS = 32 << 20, 4 << 20, 4
#: Rows of (id, hash) keys that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Level of the trusted texts' quantile per language, and the slack on its logarithm over the median's.
LEVEL, SLACK = 0.99, 0.25


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the n-grams that end at each unit of each text, and the texts' boundaries in them."""
    lead = chr(START) * (ORDER - 1)
    raw = "".join([lead + (t or "") for t in texts]).encode("utf-16-le", "surrogatepass")
    units = np.frombuffer(raw, "<u2").astype(np.uint64)
    size = np.array([len((t or "").encode("utf-16-le", "surrogatepass")) // 2 for t in texts], np.int64)
    ends = np.cumsum(size + ORDER - 1)
    key = np.zeros(len(units), np.uint64)
    for k in range(ORDER):
        key[ORDER - 1 :] |= units[ORDER - 1 - k : len(units) - k] << np.uint64(16 * k)
    inside = np.ones(len(units), bool)
    for k in range(ORDER - 1):
        inside[ends - size - 1 - k] = False
    return key[inside].view(np.int64), np.concatenate([[0], np.cumsum(size)])


def _text_id() -> Column:
    return F.xxhash64("doc_id", "lang", "text", F.col("lang").isNull())


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents as compressed blobs: less to write and shuffle, and a few at a time to hold."""
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 7))
    chunk, size, held = 0, CHUNK_BYTES, []
    bytes_of = lambda rows: rows.column("text").nbytes

    def blob() -> pa.RecordBatch:
        nonlocal chunk, size
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        if size + bytes_of(rows) > CHUNK_BYTES:
            chunk, size = int.from_bytes(os.urandom(8), "little", signed=True), 0  # only tells chunks apart
        size += bytes_of(rows)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=options) as out:
            out.write_batch(rows)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "packed"])

    for batch in slices(batches, "text", BLOB_BYTES):
        if held and sum(map(bytes_of, held)) + bytes_of(batch) > BLOB_BYTES:
            yield blob()
        held.append(batch)
    if held:
        yield blob()


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    for batch in batches:
        for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("packed"), strict=True):
            for rows in slices(pa.ipc.open_stream(blob.as_buffer()), "text", 1 << 20):
                yield chunk, rows


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: distinct n-grams of each chunk and language; counts of trusted text."""
    wanted: dict[tuple[int, str], np.ndarray] = {}
    counted: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    schema = pa.schema([("chunk", pa.int64()), ("lang", pa.string()), ("g", pa.int64()), ("n", pa.int64())])

    def rows(chunk: int | None, lang: str, keys: np.ndarray, n: np.ndarray | None) -> pa.RecordBatch:
        size = len(keys)
        return pa.RecordBatch.from_arrays(
            [pa.array([chunk], pa.int64()).take(pa.array(np.zeros(size, np.int64))), pa.array([lang]).take(pa.array(np.zeros(size, np.int64))), pa.array(keys), pa.nulls(size, pa.int64()) if n is None else pa.array(n)],
            schema=schema,
        )

    last = None
    for chunk, batch in _unpacked(batches):
        if chunk != last:  # a chunk's blobs follow each other; sums and distinct follow
            yield from (rows(c, k, v, None) for (c, k), v in wanted.items())
            wanted.clear()
            last = chunk
        groups: dict[tuple[str, bool], list[str]] = {}
        for text, lang, t in zip(*(batch.column(c).to_pylist() for c in ("text", "lang", "trained")), strict=True):
            if text:
                groups.setdefault((lang, t), []).append(text)
        for (lang, t), own in groups.items():
            keys = grams(own)[0]
            if t:
                keys, n = np.unique(keys, return_counts=True)
                if lang in counted:
                    both, where = np.unique(np.concatenate([counted[lang][0], keys]), return_inverse=True)
                    counted[lang] = both, np.bincount(where, np.concatenate([counted[lang][1], n]), len(both)).astype(np.int64)
                else:
                    counted[lang] = keys, n.astype(np.int64)
            else:
                keys = np.unique(keys)
            seen = wanted.get((chunk, lang))
            wanted[chunk, lang] = keys if seen is None else np.union1d(seen, keys)
        if sum(len(v[0]) for v in counted.values()) > 1_000_000:  # what a task holds is bounded
            yield from (rows(None, k, *v) for k, v in counted.items())
            counted.clear()
    yield from (rows(c, k, v, None) for (c, k), v in wanted.items())
    yield from (rows(None, k, *v) for k, v in counted.items())


def _suffix(g: Column, order: int) -> Column:
    return g.bitwiseAND(F.lit((1 << 16 * order) - 1)) if order < 4 else g


def _discounts(stacked: DataFrame) -> DataFrame:
    """Modified Kneser-Ney discounts of every order and language (a row each), and the distinct units of the language."""
    n = [F.sum((F.col("n") == i).cast("double")).alias(f"n{i}") for i in (1, 2, 3, 4)]
    rows = []
    for r in stacked.groupBy("k", "lang").agg(F.count("*").alias("size"), *n).collect():
        have = {i: r[f"n{i}"] for i in (1, 2, 3, 4)}
        y = have[1] / (have[1] + 2 * have[2]) if have[1] + 2 * have[2] else None
        found = [i - (i + 1) * y * have[i + 1] / have[i] if y is not None and have[i] else i - 0.5 for i in (1, 2, 3)]
        rows.append((r.k, r.lang, *[max(0.05, min(i - 0.05, d)) for i, d in zip((1, 2, 3), found, strict=True)], r.size))
    return F.broadcast(stacked.sparkSession.createDataFrame(rows, "k int, lang string, d1 double, d2 double, d3 double, size long"))


def probabilities(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``lang``, ``g`` and probability ``p`` of the last unit after the others, for distinct wanted n-grams.

    ``counts`` holds the n-grams of order 4 (``lang``, ``g``, ``n``).  All orders are
    stacked in one table: counts of order 4, numbers of distinct left neighbours below.
    """
    tables = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        tables[k] = tables[k + 1].groupBy("lang", _suffix(F.col("g"), k).alias("g")).agg(F.count("*").alias("n"))
    stacked = None
    for k, t in tables.items():
        t = t.select(F.lit(k).alias("k"), "lang", "g", "n")
        stacked = t if stacked is None else stacked.union(t)
    stacked = materialize(stacked, "stacked")
    discounts = _discounts(stacked)
    ctx = F.when(F.col("k") > 1, F.shiftrightunsigned("g", 16)).otherwise(F.lit(0).cast("long"))
    sums = [F.sum("n").alias("total")] + [F.sum((F.col("n") == i).cast("double")).alias(f"c{i}") for i in (1, 2)] + [F.sum((F.col("n") >= 3).cast("double")).alias("c3")]
    contexts = stacked.groupBy("k", "lang", ctx.alias("ctx")).agg(*sums)
    levels = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), _suffix(F.col("g"), k).alias("g")) for k in tables])).alias("x")
    rows = wanted.select("lang", levels).select("x.k", "lang", "x.g").distinct()
    rows = rows.join(stacked, ["k", "lang", "g"], "left").withColumn("ctx", ctx)
    rows = rows.join(contexts, ["k", "lang", "ctx"], "left").join(discounts, ["k", "lang"], "left")
    n = F.col("n")
    own = F.coalesce((n - F.when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))) / F.col("total"), F.lit(0.0))
    # the weight that a context leaves to the lower order; an unknown context leaves all
    rest = F.coalesce((F.col("d1") * F.col("c1") + F.col("d2") * F.col("c2") + F.col("d3") * F.col("c3")) / F.col("total"), F.lit(1.0))
    parts = materialize(rows.select("k", "lang", "g", own.alias("own"), rest.alias("rest"), "size"), "parts")
    forget(stacked)
    out = parts.filter(F.col("k") == ORDER).select("lang", "g", F.col("own").alias("p"), F.col("rest").alias("w"))
    for k in range(ORDER - 1, 0, -1):
        lower = parts.filter(F.col("k") == k).select("lang", F.col("g").alias("s"), F.col("own").alias("lower_own"), F.col("rest").alias("lower_rest"), "size")
        out = out.withColumn("s", _suffix(F.col("g"), k)).join(lower, ["lang", "s"])
        p, w = F.col("p") + F.col("w") * F.col("lower_own"), F.col("w") * F.col("lower_rest")
        out = out.select("lang", "g", (p + w / (F.col("size") + 1) if k == 1 else p).alias("p"), w.alias("w"))
    model = materialize(out.select("lang", "g", "p"), "model")
    forget(parts)
    return model


SCORED = T.StructType().add("doc_id", "long").add("text_id", "long").add("lang", "string").add("trusted", "boolean").add("trained", "boolean").add("n_units", "long").add("perplexity", "double")


def _score(packed: pa.Table, model: pa.Table) -> pa.Table:
    names = model.column("lang").combine_chunks().dictionary_encode()
    which, keys, logs = names.indices.to_numpy(zero_copy_only=False), model.column("g").to_numpy(), model.column("logp").to_numpy()
    tables = {}
    for i, lang in enumerate(names.dictionary.to_pylist()):
        fresh, at = np.unique(keys[which == i], return_index=True)
        tables[lang] = KeyTable(fresh), logs[which == i][at]
    out = []
    for _, batch in _unpacked(packed.to_batches()):
        langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
        ppl, sizes = np.full(len(langs), np.nan), np.zeros(len(langs), np.int64)
        for lang in set(langs):
            mine = np.array([i for i, x in enumerate(langs) if x == lang])
            found, bounds = grams([texts[i] for i in mine])
            sizes[mine] = np.diff(bounds)
            if lang in tables and len(found):
                table, values = tables[lang]
                if (place := table.find(found)).min() < 0:
                    raise RuntimeError("an n-gram of a document has no probability")
                full = mine[sizes[mine] > 0]
                starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                ppl[full] = np.exp(-np.add.reduceat(values[place], starts) / sizes[full])
        columns = [batch.column(c) for c in SCORED.names[:5]]
        out.append(pa.RecordBatch.from_arrays([*columns, pa.array(sizes), pa.array(ppl, mask=np.isnan(ppl))], names=SCORED.names))
    tables.clear()
    trim()
    return pa.Table.from_batches(out)


def small(rows: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if it has ``limit`` rows at most, else as it is (joined by a shuffle)."""
    return F.broadcast(rows) if rows.count() <= limit else rows


def perplexities(docs: DataFrame, trusted_ids: DataFrame) -> DataFrame:
    """``doc_id``, ``text_id``, ``lang``, ``n_units``, ``perplexity``, ``trusted`` and ``trained`` of every document.

    The model of a language is trained on the documents of that language whose ids are
    among ``trusted_ids`` (column doc_id), but for one in HELD_OUT by a hash of the id.  A null language is a group of its own;
    languages without trusted text, and documents without text, have null perplexity.
    Repeated rows give a row each; null ids are never trusted.
    """
    spark = docs.sparkSession
    ids = trusted_ids.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
    ids = ids.withColumns({"trusted": F.lit(True), "trained": F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) != 0})
    ids = materialize(ids, "trusted")
    # a language is "s" and its name, no language "n"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("s"), F.col("lang").cast("string")), F.lit("n")).alias("lang"), F.col("text").cast("string").alias("text"), _text_id().alias("text_id"))
    flags = {c: F.coalesce(c, F.lit(False)) for c in ("trusted", "trained")}
    packed = materialize(rows.join(small(ids), "doc_id", "left").withColumns(flags).mapInArrow(_pack, "chunk long, packed binary"), "packed")
    with small_batches(spark, BLOBS):
        gathered = materialize(packed.mapInArrow(_gather, "chunk long, lang string, g long, n long"), "grams")
    counts = materialize(gathered.filter("n is not null").groupBy("lang", "g").agg(F.sum("n").alias("n")), "counts")
    wanted = gathered.filter("n is null").join(counts.select("lang").distinct(), "lang", "left_semi").select("chunk", "lang", "g")
    model = probabilities(counts, wanted.select("lang", "g").distinct())
    own = materialize(wanted.join(model, ["lang", "g"]).select("chunk", "lang", "g", F.log("p").alias("logp")), "own")
    forget(ids, gathered, counts, model)
    scored = packed.groupBy("chunk").cogroup(own.groupBy("chunk")).applyInArrow(_score, SCORED)
    scored = scored.withColumn("lang", F.when(F.col("lang") != "n", F.expr("substring(lang, 2)")))
    scores = materialize(scored.select("doc_id", "text_id", "lang", "n_units", "perplexity", "trusted", "trained"), "scores")
    forget(packed, own)
    return scores


def thresholds(scores: DataFrame, level: float = LEVEL, slack: float = SLACK) -> DataFrame:
    """Per language: the perplexity above which a document is rejected.

    The quantile at ``level`` of the perplexities of trusted texts that the model was not
    trained on, with a slack: its logarithm's distance from that of the median is
    stretched by 1 + ``slack``.
    """
    per = scores.filter("trusted and not trained and perplexity is not null").groupBy("lang").agg(F.percentile_approx(F.log("perplexity"), F.array(F.lit(0.5), F.lit(level)), 20000).alias("q"))
    return per.select("lang", F.exp(F.col("q")[0] + (1 + slack) * (F.col("q")[1] - F.col("q")[0])).alias("threshold"))


def judge(docs: DataFrame, trusted_ids: DataFrame, level: float = LEVEL, slack: float = SLACK) -> DataFrame:
    """Per document: the columns of perplexities(), its language's ``threshold`` and ``kept``.

    A document is rejected only if its perplexity is above the threshold; trusted
    documents, and those without perplexity or threshold, are kept.
    """
    scores = perplexities(docs, trusted_ids)
    limits = thresholds(scores, level, slack).withColumnRenamed("lang", "of")
    out = scores.join(F.broadcast(limits), F.col("lang").eqNullSafe(F.col("of")), "left").drop("of")
    return out.withColumn("kept", F.coalesce(F.col("trusted") | (F.col("perplexity") <= F.col("threshold")), F.lit(True)))


def filter_quality(docs: DataFrame, trusted_ids: DataFrame, level: float = LEVEL, slack: float = SLACK) -> DataFrame:
    """The documents (all columns) that judge() keeps."""
    gone = materialize(judge(docs, trusted_ids, level, slack).filter("not kept").select(F.col("text_id").alias("__id")).distinct(), "rejected")
    return docs.withColumn("__id", _text_id()).join(small(gone), "__id", "left_anti").select(*docs.columns)
