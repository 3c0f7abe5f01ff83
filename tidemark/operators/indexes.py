"""Secondary indexes: built by one Spark job each, kept beside the table, always rechecked.

An index entry in the manifest names its method, column, covered fragments and the
place of its data.  ``candidates`` gives the row addresses that may match; the caller
joins them to the scan and applies its condition again, so an index changes speed only.
"""

from __future__ import annotations

import time
import uuid
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalar import tokens
from tidemark.operators import search
from tidemark.sources.table import tasks_for

METHODS = ("zonemap", "btree", "bitmap", "label_list", "ngram", "bloomfilter", "rtree", "fts", "inverted")
OPTIONS = {
    "zonemap": {"rows_per_zone"}, "btree": {"zone_size", "build_mode"}, "bitmap": set(), "label_list": set(), "ngram": set(),
    "bloomfilter": {"number_of_items", "probability"}, "rtree": {"page_size"},
    "fts": {"base_tokenizer", "language", "max_token_length", "lower_case", "stem", "remove_stop_words", "ascii_folding", "with_position"},
}
SHARED = {"num_segments", "train"}
#: How much more a task of a build holds than the rows that it is made of: a posting for each word, four bits for each row.
SPREAD = {"fts": 2, "bloomfilter": 4}


def _addr(table, m) -> DataFrame:
    return table._scan(m, {"_rowaddr"})


def create_index(table, name: str, method: str, columns: list[str], **options) -> tuple[int, str]:
    """(fragments indexed, index name).  The same name replaces in one commit."""
    from tidemark.operators.prune import zone_statistics

    method, name = method.lower(), name.lower()
    if method not in METHODS:
        raise ValueError(f"unknown index method {method}")
    method = "fts" if method == "inverted" else method
    if len(columns) != 1:
        raise ValueError("an index has one column")
    if unknown := set(options) - OPTIONS[method] - SHARED:
        raise ValueError(f"unknown options {sorted(unknown)}")
    for option in ("stem", "remove_stop_words"):
        if str(options.get(option, False)).lower() != "false":
            raise ValueError(f"{option} is not supported: terms are indexed as they stand")
    m = table.manifest()
    column = columns[0]
    head = column.split(".")[0]
    if head not in m.struct.names:
        raise ValueError(f"no column {column}")
    kind = table.spark.createDataFrame([], m.struct).select(F.col(column)).schema[0].dataType
    if method in ("btree", "bitmap", "ngram", "bloomfilter", "zonemap", "fts") and isinstance(kind, (T.StructType, T.MapType, T.ArrayType)):
        raise ValueError(f"{column} must be a leaf for {method}")
    if method == "label_list" and not isinstance(kind, T.ArrayType):
        raise ValueError(f"{column} must be an array")
    train = str(options.get("train", True)).lower() != "false"
    segments = options.get("num_segments")
    if segments is not None:
        if int(segments) < 1:
            raise ValueError("num_segments must be positive")
        if not train or options.get("build_mode") == "range":
            raise ValueError("num_segments goes with neither train=false nor range mode")
    fragments = [f["id"] for f in m.fragments] if train else []
    size = sum(f["bytes"] for f in m.fragments) * SPREAD.get(method, 1)
    parts = min(len(fragments) or 1, int(segments) if segments else table.spark.sparkContext.defaultParallelism)
    parts = parts if segments else max(parts, tasks_for(size))
    entry = {"name": name, "type": method, "column": column, "fragments": fragments, "options": {k: str(v) for k, v in options.items()}, "created_at": time.time()}
    if fragments:
        if method == "zonemap":
            entry["zones"] = zone_statistics(table, m, column, int(options.get("rows_per_zone", 8192)))
        else:
            place = f"index/{name}/{uuid.uuid4().hex}"
            data = _build(method, _addr(table, m).select(F.col(column).alias("v"), F.col("_rowaddr").alias("rowaddr")), parts, options)
            data.write.parquet(table.store.path(place))
            entry["place"], entry["built"] = place, len(fragments)
            if method == "fts":
                entry["lengths"] = f"index/{name}/{uuid.uuid4().hex}"
                _lengths(_addr(table, m).select(F.col(column).alias("v"), F.col("_rowaddr").alias("rowaddr")), entry["options"]).write.parquet(table.store.path(entry["lengths"]))
    table._commit(m, "create index", indexes=m.indexes | {name: entry})
    return len(fragments), name


def _build(method: str, rows: DataFrame, parts: int, options: dict) -> DataFrame:
    if method == "btree":
        ordered = rows.filter("v is not null")
        if options.get("build_mode") == "range":
            return ordered.repartitionByRange(parts, "v").sortWithinPartitions("v", "rowaddr")
        return ordered.repartition(parts, F.shiftrightunsigned("rowaddr", 32)).sortWithinPartitions("v", "rowaddr")
    if method == "bitmap":
        return _bitmaps(rows)
    if method == "label_list":
        return _bitmaps(rows.select(F.explode(F.array_distinct("v")).alias("v"), "rowaddr"))
    if method == "ngram":
        return _bitmaps(rows.filter("v is not null").select(F.explode(F.array_distinct(trigrams(F.col("v")))).alias("v"), "rowaddr"))
    if method == "bloomfilter":
        return _blooms(rows, int(options.get("number_of_items", 8192)), parts)
    if method == "rtree":
        size = int(options.get("page_size", 4096))
        if size < 2:
            raise ValueError("page_size must be 2 or more")
        page = F.floor(F.col("rowaddr").bitwiseAND(F.lit(0xFFFFFFFF)) / size)
        boxes = rows.filter("v is not null").groupBy(F.shiftrightunsigned("rowaddr", 32).alias("fragment"), page.alias("page"))
        return boxes.agg(F.min("v.x").alias("x0"), F.max("v.x").alias("x1"), F.min("v.y").alias("y0"), F.max("v.y").alias("y1"), F.min("rowaddr").alias("a0"), F.max("rowaddr").alias("a1"))
    return _posts(rows.repartition(parts, "rowaddr"), options).repartitionByRange(parts, "term", "rowaddr").sortWithinPartitions("term", "rowaddr")  # a frequent term's rows go to several tasks


def _true(value) -> bool:
    return str(value).lower() == "true"


def _analysis(options: dict) -> dict:
    """How an index splits texts; a query must be split alike."""
    out = {k: _true(options[k]) for k in ("lower_case", "ascii_folding") if k in options}
    if "base_tokenizer" in options:
        out["base_tokenizer"] = str(options["base_tokenizer"])
    if "max_token_length" in options:
        out["max_token_length"] = int(options["max_token_length"])
    return out


def _posts(rows: DataFrame, options: dict) -> DataFrame:
    """The places of each term of each row, put together inside the row: no row is grouped or moved."""
    words = rows.filter("v is not null").select("rowaddr", tokens(F.col("v"), **_analysis(options)).alias("w"))
    words = words.select("rowaddr", F.sort_array(F.transform("w", lambda w, i: F.struct(w.alias("term"), i.alias("place")))).alias("w"))
    at = lambda i: F.get(F.col("w"), i)
    new = F.transform("w", lambda w, i: F.when((i == 0) | (w["term"] != at(i - 1)["term"]), i))  # where a term begins
    words = words.select("rowaddr", "w", F.size("w").alias("length"), F.filter(new, lambda i: i.isNotNull()).alias("starts"))
    last = lambda j: F.coalesce(F.get(F.col("starts"), j + 1), F.col("length")) - 1
    own = F.transform("starts", lambda i, j: F.struct(at(i)["term"].alias("term"), F.transform(F.sequence(i, last(j)), lambda k: at(k)["place"]).alias("places")))
    return words.select("rowaddr", "length", F.explode(own).alias("post")).select("post.term", "rowaddr", "length", "post.places")


def _lengths(rows: DataFrame, options: dict) -> DataFrame:
    return rows.filter("v is not null").select("rowaddr", F.size(tokens(F.col("v"), **_analysis(options))).alias("length"))


def trigrams(text: Column) -> Column:
    low = F.lower(text)
    return F.when(F.length(low) >= 3, F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def _bitmaps(rows: DataFrame) -> DataFrame:
    """Value to row sets: a bitmap per value and block of addresses, so no value's rows meet in one place."""
    at = rows.select("v", F.expr("bitmap_bucket_number(rowaddr + 1)").alias("block"), F.expr("bitmap_bit_position(rowaddr + 1)").alias("bit"))
    return at.groupBy("v", "block").agg(F.expr("bitmap_construct_agg(bit)").alias("bits")).repartitionByRange("v", "block").sortWithinPartitions("v", "block")


def _blooms(rows: DataFrame, items: int, tasks: int) -> DataFrame:
    """A fixed-size bit set of four hashes for every block of ``items`` rows; a block's rows are dealt to one task."""
    block = F.floor(F.col("rowaddr").bitwiseAND(F.lit(0xFFFFFFFF)) / items)
    rows = rows.filter("v is not null").select("v", F.shiftrightunsigned("rowaddr", 32).alias("fragment"), block.alias("block")).repartition(tasks, "fragment", "block")
    spread = F.explode(F.array(*[F.pmod(F.xxhash64("v", F.lit(i)), F.lit(4 * 8 * 4096)) for i in range(4)]))
    bits = rows.select("fragment", "block", spread.alias("h")).distinct()
    parts = bits.select("fragment", "block", F.expr("bitmap_bucket_number(h + 1)").alias("part"), F.expr("bitmap_bit_position(h + 1)").alias("bit"))
    return parts.groupBy("fragment", "block", "part").agg(F.expr("bitmap_construct_agg(bit)").alias("bits")).withColumn("items", F.lit(items))


def _bit(bits: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.pmod(F.floor(byte / F.pow(F.lit(2), position % 8)), F.lit(2)) == 1


def _members(index: DataFrame, *kept: str) -> DataFrame:
    """Addresses of the rows in bitmaps."""
    inside = F.explode(F.filter(F.sequence(F.lit(0), F.lit(32767)), lambda i: _bit(F.col("bits"), i))).alias("bit")
    return index.select(*kept, "block", inside).select(*kept, ((F.col("block") - 1) * 32768 + F.col("bit")).alias("rowaddr"))


def candidates(table, name: str, values: list, version: int | None = None) -> DataFrame:
    """Addresses (``rowaddr``) of rows that may hold one of the values (for ngram: contain each; for fts: have any)."""
    m = table.manifest(version)
    entry = m.indexes[name.lower()]
    data = table.spark.read.parquet(table.store.path(entry["place"]))
    kind = entry["type"]
    if kind == "btree":
        return data.filter(F.col("v").isin(values)).select("rowaddr")
    if kind in ("bitmap", "label_list"):
        found = F.col("v").isin([v for v in values if v is not None])
        return _members(data.filter(found | F.col("v").isNull() if None in values else found)).distinct()
    if kind == "ngram":
        wanted = sorted({v.lower()[i : i + 3] for v in values for i in range(len(v) - 2)})
        hits = _members(data.filter(F.col("v").isin(wanted)), "v")
        return hits.groupBy("rowaddr").agg(F.count("*").alias("n")).filter(F.col("n") == len(wanted)).select("rowaddr")
    if kind == "bloomfilter":
        blocks = None
        kind = table.spark.createDataFrame([], m.struct).select(F.col(entry["column"])).schema[0].dataType
        for v in values:
            tests = []
            for i in range(4):
                h = F.pmod(F.xxhash64(F.lit(v).cast(kind), F.lit(i)), F.lit(4 * 8 * 4096))
                tests.append((F.col("part") == F.floor(h / 32768) + 1) & _bit(F.col("bits"), h % 32768))
            hit = data.groupBy("fragment", "block", "items").agg(*[F.max(t).alias(f"t{i}") for i, t in enumerate(tests)]).filter("t0 and t1 and t2 and t3").select("fragment", "block", "items")
            blocks = hit if blocks is None else blocks.union(hit)
        rows = _addr(table, m).select("_rowaddr").withColumn("fragment", F.shiftrightunsigned("_rowaddr", 32))
        items = int(entry["options"].get("number_of_items", 8192))
        rows = rows.withColumn("block", F.floor(F.col("_rowaddr").bitwiseAND(F.lit(0xFFFFFFFF)) / items))
        return rows.join(blocks.distinct(), ["fragment", "block"], "left_semi").select(F.col("_rowaddr").alias("rowaddr"))
    if kind == "fts":
        return data.filter(F.col("term").isin(values)).select("rowaddr").distinct()
    raise ValueError(f"{kind} has no candidates")


def box_candidates(table, name: str, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Address ranges (``a0``, ``a1``) of the pages whose box meets the given box."""
    m = table.manifest()
    data = table.spark.read.parquet(table.store.path(m.indexes[name.lower()]["place"]))
    return data.filter((F.col("x0") <= x1) & (F.col("x1") >= x0) & (F.col("y0") <= y1) & (F.col("y1") >= y0)).select("a0", "a1", "fragment", "page")


def box_read(table, name: str, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Rows with their column's point in the box, from the pages whose box meets it; fragments that the index doesn't cover are scanned."""
    m = table.manifest()
    entry = m.indexes[name.lower()]
    size, column = int(entry["options"].get("page_size", 4096)), entry["column"]
    pages = box_candidates(table, name, x0, y0, x1, y1).select("fragment", "page")
    found = {r[0] for r in pages.select("fragment").distinct().collect()} & set(entry["fragments"])
    inside = F.col(f"{column}.x").between(x0, x1) & F.col(f"{column}.y").between(y0, y1)
    at = table._scan(m, {"_rowaddr"}, found)
    at = at.withColumns({"fragment": F.shiftrightunsigned("_rowaddr", 32), "page": F.floor(F.col("_rowaddr").bitwiseAND(F.lit(0xFFFFFFFF)) / size)})
    rows = at.join(pages, ["fragment", "page"], "left_semi").filter(inside).select(*m.struct.names)
    rest = {f["id"] for f in m.fragments} - set(entry["fragments"])
    return rows.unionByName(table.read(fragments=rest).filter(inside)) if rest else rows


def indexed_read(table, name: str, values: list, condition: str, use_scalar_index: bool = True) -> DataFrame:
    """Rows that satisfy the condition, found through the index; fragments that it doesn't cover are scanned."""
    m = table.manifest()
    entry = m.indexes[name.lower()]
    if not use_scalar_index or not entry.get("place"):
        return table.read(where=condition)
    covered = set(entry["fragments"])
    hits = candidates(table, name, values)
    found = {r[0] for r in hits.select(F.shiftrightunsigned("rowaddr", 32)).distinct().collect()}  # a number per fragment at most
    rows = table._scan(m, {"_rowaddr"}, covered & found).join(hits, F.col("_rowaddr") == F.col("rowaddr"), "left_semi").filter(condition).select(*m.struct.names)
    rest = {f["id"] for f in m.fragments} - covered
    return rows.unionByName(table.read(where=condition, fragments=rest)) if rest else rows


def index_scores(table, m, name: str, query: str, options: str | None = None) -> DataFrame:
    """BM25 by row address (``rowaddr``, ``_score``) from a full-text index, equal to ``search.bm25`` of the version's rows.

    Only the query's terms are read of the postings; fragments that the index doesn't
    cover are split here, and rows deleted since it was built count no more.
    """
    entry = m.indexes[name.lower()]
    if entry["type"] != "fts" or not entry.get("lengths"):
        raise ValueError(f"{name} is no trained full-text index")
    opts, terms = search.parse_options(options), search.query_tokens(query, **_analysis(entry["options"]))
    if not terms:
        raise ValueError("the query has no token")
    read = lambda place: table.spark.read.parquet(table.store.path(entry[place]))
    posts, lengths = read("place"), read("lengths")
    term, head = F.col("term"), opts["prefix_length"]
    near = lambda t: F.levenshtein(term, F.lit(t), opts["fuzziness"]).between(0, opts["fuzziness"]) & term.startswith(t[:head])
    tests = [near(t) if opts["fuzziness"] else term == t for t in terms]
    wanted = reduce(or_, tests) if opts["fuzziness"] else term.isin(terms)
    posts = posts.filter(wanted)
    there = {f["id"]: f for f in m.fragments}
    covered, rest = set(entry["fragments"]) & set(there), set(there) - set(entry["fragments"])
    if len(covered) < entry["built"]:
        known = F.broadcast(table.spark.createDataFrame([(i,) for i in sorted(covered)], "__id long"))
        posts, lengths = (x.join(known, F.shiftrightunsigned("rowaddr", 32) == F.col("__id"), "left_semi") for x in (posts, lengths))
    if any(there[i]["deleted"] for i in covered):
        gone = table.deleted(m, sum(f["deleted"] for f in m.fragments))
        posts, lengths = (x.join(gone, "rowaddr", "left_anti") for x in (posts, lengths))
    if rest:
        new = table._scan(m, {"_rowaddr"}, rest).select(F.col(entry["column"]).alias("v"), F.col("_rowaddr").alias("rowaddr"))
        found = _posts(new, entry["options"]).filter(wanted)
        posts, lengths = posts.select("term", "rowaddr", "length", "places").unionByName(found), lengths.unionByName(_lengths(new, entry["options"]))
    hits = posts.groupBy("rowaddr").agg(F.max("length").alias("length"), *[F.sum(F.when(x, F.size("places"))).alias(f"tf{j}") for j, x in enumerate(tests)])
    n, average = lengths.agg(F.count("*"), F.avg("length")).first()
    seen = hits.agg(*[F.count(f"tf{j}") for j in range(len(terms))]).first()
    score = F.lit(0.0)
    for j, d in enumerate(seen):
        tf = F.coalesce(f"tf{j}", F.lit(0)).cast("double")
        score = score + F.log(F.lit(1 + (n - d + 0.5) / (d + 0.5))) * tf * (search.K1 + 1) / (tf + search.K1 * (1 - search.B + search.B * F.col("length") / (average or 1.0)))
    if opts["operator"] == "AND":
        hits = hits.dropna(subset=[f"tf{j}" for j in range(len(terms))])
    return hits.select("rowaddr", (score * opts["boost"]).alias("_score"))


def index_search(table, name: str, query: str, k: int = 10, columns=None, filter: str | None = None, options: str | None = None, version: int | None = None) -> DataFrame:
    """As ``search.search`` on the index's column, through the index: only fragments of the k best rows are read.

    With a filter, or with stable row ids (which order ties), all rows that match are
    joined first.
    """
    search._check(k, 0)
    m = table.manifest(version)
    shown = search._columns(table.spark.createDataFrame([], m.struct), columns, ())
    scored = index_scores(table, m, name, query, options)
    if filter or _true(m.properties.get("enable_stable_row_ids", "false")):
        rows = table._scan(m, {"_rowaddr", "_rowid"})
        rows = (rows.filter(filter) if filter else rows).join(scored, F.col("_rowaddr") == F.col("rowaddr"))
        return rows.orderBy(F.desc("_score"), "_rowid").limit(k).select(*shown, F.col("_score").cast("float"))
    best = scored.orderBy(F.desc("_score"), "rowaddr").limit(k).collect()  # k rows, the feature's own limit
    top = table.spark.createDataFrame([tuple(r) for r in best], "rowaddr long, _score double")
    rows = table._scan(m, {"_rowaddr"}, {r[0] >> 32 for r in best})
    return rows.join(F.broadcast(top), F.col("_rowaddr") == F.col("rowaddr")).orderBy(F.desc("_score"), "rowaddr").select(*shown, F.col("_score").cast("float"))


def text_index(m, columns: list[str] | None) -> str | None:
    """The name of a trained full-text index on the one column, if there is one."""
    return next((n for n, e in sorted(m.indexes.items()) if columns and len(columns) == 1 and e["type"] == "fts" and e.get("lengths") and e["column"].lower() == columns[0].lower()), None)


def drop_index(table, name: str) -> tuple[str, str]:
    m = table.manifest()
    if name.lower() not in m.indexes:
        raise ValueError(f"no index {name}")
    table._commit(m, "drop index", indexes={k: v for k, v in m.indexes.items() if k != name.lower()})
    return name.lower(), "dropped"


def show_indexes(table) -> DataFrame:
    m = table.manifest()
    rows = []
    for name, i in sorted(m.indexes.items()):
        inside = [f for f in m.fragments if f["id"] in i["fragments"]]
        outside = [f for f in m.fragments if f["id"] not in i["fragments"]]
        live = lambda fs: sum(f["rows"] - f["deleted"] for f in fs)
        rows.append((name, [i["column"]], i["type"], len(inside), live(inside), len(outside), live(outside)))
    return table.spark.createDataFrame(rows, "name string, fields array<string>, index_type string, num_indexed_fragments long, num_indexed_rows long, num_unindexed_fragments long, num_unindexed_rows long")
