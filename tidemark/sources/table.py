"""Versioned tables: Parquet fragments chosen by a manifest.

    <table>/_versions/00000001.json    schema, properties, fragments, indexes, sharding, key
    <table>/_refs/00000001.json        branches and tags; the last counts
    <table>/data/<commit>/*.parquet    a fragment per file, or several files in order
    <table>/deletes/<commit>           addresses of deleted rows
    <table>/index/<name>/<commit>      index data

A row's address is ``fragment << 32 | row index``; in a fragment of several files
(``files`` in its entry), the index goes on from file to file.  Reading is a plain Parquet scan of
the manifest's files, so projection and filters reach the files; addresses and deletions
are joined only where a query asks for them or rows were deleted.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections import OrderedDict
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.schema import check_properties, check_rows
from tidemark.sources.store import Conflict, Store

HIDDEN = ("_rowid", "_rowaddr", "_row_last_updated_at_version", "_row_created_at_version", "_fragid")
STORED = T.StructType().add("__rowid", "long").add("__created", "long").add("__updated", "long")
#: Deleted addresses and fragment lists up to this many rows are broadcast.
BROADCAST_ROWS = 1_000_000
MAX_ROWS_PER_FILE = 1_000_000
#: Bytes of files for one task of a shuffle of whole rows, which take several times as much there and in a sort.
TASK_BYTES = 16 << 20
#: Days after which a file that no version names is taken for the rest of a failed write.
UNVERIFIED_DAYS = 7
#: Manifests kept in memory by this process, the least used go first.
CACHED_MANIFESTS = 256
_manifests: OrderedDict[tuple, str] = OrderedDict()


#: Bytes of a value by its type, as Spark's own estimates have them; 20 for any other.
_WIDTHS = {"boolean": 1, "byte": 1, "short": 2, "integer": 4, "float": 4, "date": 4, "long": 8, "double": 8, "timestamp": 8, "timestamp_ntz": 8, "decimal": 16, "binary": 100}


@dataclass
class ReadOptions:
    """Options of a read; unknown ones are refused."""

    version: int | None = None
    timestamp: float | None = None
    pushDownFilters: bool = True
    use_scalar_index: bool = True
    topN_push_down: bool = True
    batch_size: int = 8192
    block_size: int | None = None
    index_cache_size: int = 6 << 30
    metadata_cache_size: int = 1 << 30
    executor_credential_refresh: bool = True
    fullTextQuery: str | None = None


@dataclass
class WriteOptions:
    write_mode: str = "append"
    max_row_per_file: int = MAX_ROWS_PER_FILE
    max_rows_per_group: int | None = None
    max_bytes_per_file: int | None = None
    file_format_version: str | None = None
    use_queued_write_buffer: bool = False
    queue_depth: int = 8
    batch_size: int = 8192
    enable_stable_row_ids: bool | None = None
    use_large_var_types: bool = False
    max_batch_bytes: int = 256 << 20
    blob_pack_file_size_threshold: int | None = None
    #: The files, in the order of the rows' partitions, make up so many fragments (fewer if the files are fewer); else each is one.
    fragment_count: int | None = None


@dataclass
class Manifest:
    version: int
    schema: dict
    timestamp: float = 0.0
    operation: str = "create"
    properties: dict = field(default_factory=dict)
    fragments: list[dict] = field(default_factory=list)
    deletes: list[str] = field(default_factory=list)
    next_fragment: int = 0
    indexes: dict = field(default_factory=dict)
    sharding: list | None = None
    primary_key: list | None = None

    @property
    def struct(self) -> T.StructType:
        return T.StructType.fromJson(self.schema)

    @property
    def rows(self) -> int:
        return sum(f["rows"] - f["deleted"] for f in self.fragments)


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files and rows that a DataFrame reads, as the plan knows them; what it doesn't know counts as none."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(s for s in sizes if s < 1 << 60)


def tasks_for(size: int) -> int:
    """Tasks among which so many bytes of files are dealt, that each stays small however many there are."""
    return max(1, -(-size // TASK_BYTES))


def pieces(fragment: dict) -> list[tuple[str, int, int]]:
    """A fragment's files, each with the index of its first row in the fragment and its rows."""
    out, first = [], 0
    for name, rows in fragment.get("files") or [(fragment["file"], fragment["rows"])]:
        out.append((name, first, rows))
        first += rows
    return out


def _place(name: str) -> tuple[int, int, str]:
    """Orders the files of a write as the rows lay in its partitions."""
    found = re.search(r"part-(\d+)-.*?(?:[-.]c(\d+))?[.]", name.rpartition("/")[2])
    return (int(found[1]), int(found[2] or 0), name) if found else (0, 0, name)


def _grouped(files: list[dict], count: int) -> list[dict]:
    """Neighbouring files as ``count`` fragments of about as many files each."""
    count = min(count, len(files))
    out = []
    for i in range(count):
        own = files[i * len(files) // count : (i + 1) * len(files) // count]
        rows = sum(f["rows"] for f in own)
        if rows > 1 << 32:
            raise ValueError("a fragment has more rows than addresses")
        out.append({"files": [[f["file"], f["rows"]] for f in own], "rows": rows, "deleted": 0, "bytes": sum(f["bytes"] for f in own)} if len(own) > 1 else own[0])
    return out


class Table:
    def __init__(self, spark: SparkSession, path: str, branch: str | None = None):
        self.spark, self.path, self.branch = spark, path.rstrip("/"), branch
        self.store = Store(spark, self.path)

    # -- versions -----------------------------------------------------------------

    @property
    def _folder(self) -> str:
        return f"_branches/{self.branch}" if self.branch else "_versions"

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.store.list(self._folder) if n.endswith(".json"))

    def manifest(self, version: int | None = None, timestamp: float | None = None) -> Manifest:
        """That of a version, of the last commit not after ``timestamp`` (epoch seconds), or the latest."""
        stamps = self.store.stamps(self._folder)
        known = sorted(int(n[:-5]) for n in stamps if n.endswith(".json"))
        if not known:
            raise ValueError(f"no table at {self.path}")
        if timestamp is not None:
            if timestamp <= 0:
                raise ValueError("timestamp must be positive")
            for v in reversed(known):
                if (m := self.manifest(v)).timestamp <= timestamp:
                    return m
            raise ValueError("no version at or before this timestamp")
        version = known[-1] if version is None else version
        if version not in known:
            raise ValueError(f"version {version} does not exist")
        # a version never changes, but a table may be dropped and made again at its place: size and time tell
        name = f"{self._folder}/{version:08d}.json"
        key = (self.path, name, stamps[f"{version:08d}.json"])
        text = _manifests.pop(key, None) or self.store.read(name)
        _manifests[key] = text
        while len(_manifests) > CACHED_MANIFESTS:
            _manifests.popitem(last=False)
        return Manifest(**json.loads(text))

    def _commit(self, base: Manifest, operation: str, **changes) -> Manifest:
        made = replace(base, version=base.version + 1, timestamp=time.time(), operation=operation, **changes)
        self.store.write(f"{self._folder}/{made.version:08d}.json", json.dumps(made.__dict__), new=True)
        return made

    def _commit_rows(self, base: Manifest, operation: str, added: list[dict], deleted: dict[int, int] | None = None, deletes: list[str] = (), touched: set[int] | None = None, **changes) -> Manifest:
        """Commit on ``base``; after a conflict on the latest version, if no touched fragment changed."""
        current = base
        while True:
            fragments = [dict(f, deleted=f["deleted"] + (deleted or {}).get(f["id"], 0)) for f in current.fragments]
            emptied = {f["id"] for f in fragments if f["deleted"] >= f["rows"] and f["id"] in (deleted or {})}
            new = [dict(f, id=current.next_fragment + i, created=current.version + 1) for i, f in enumerate(added)]
            kept = [f for f in fragments if f["id"] not in emptied] + new
            try:
                return self._commit(current, operation, fragments=kept, deletes=[*current.deletes, *deletes], next_fragment=current.next_fragment + len(new), **changes)
            except Conflict:
                current = self.manifest()
                before, now = ({f["id"]: f for f in m.fragments if f["id"] in (touched or ())} for m in (base, current))
                if before != now or (touched is None and operation != "append") or base.schema != current.schema:
                    raise

    # -- creation and schema ------------------------------------------------------

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType, properties: dict | None = None, sharding: list | None = None, exist_ok: bool = False) -> Table:
        """``sharding``: ["bucket", n, column] or ["identity", column]."""
        table = cls(spark, path)
        if table.versions():
            if exist_ok:
                return table
            raise ValueError(f"a table exists at {path}")
        properties = dict(properties or {})
        check_properties(schema, properties)
        first = Manifest(1, json.loads(schema.json()), time.time(), "create", properties, sharding=sharding)
        table.store.write("_versions/00000001.json", json.dumps(first.__dict__), new=True)
        return table

    @classmethod
    def create_as(cls, spark: SparkSession, path: str, df: DataFrame, properties: dict | None = None, sharding: list | None = None, replace_table: bool = False, **options) -> Table:
        """CTAS, or RTAS: files first, then one manifest makes all visible."""
        table = cls(spark, path)
        if table.versions():
            if not replace_table:
                raise ValueError(f"a table exists at {path}")
            table.overwrite(df, properties=properties, sharding=sharding, **options)
            return table
        properties = dict(properties or {})
        check_properties(df.schema, properties)
        first = Manifest(1, json.loads(df.schema.json()), time.time(), "create", properties, sharding=sharding)
        added = [dict(f, id=i, created=1) for i, f in enumerate(table._write(df, first, **options))]
        first = replace(first, fragments=added, next_fragment=len(added))
        table.store.write("_versions/00000001.json", json.dumps(first.__dict__), new=True)
        return table

    @classmethod
    def adopt(cls, spark: SparkSession, path: str, source: str, properties: dict | None = None) -> Table:
        """A table over Parquet files that stay where they are, a fragment each: nothing is copied, footers are counted.

        The files must not change or go; vacuum never deletes them.  Folders that name
        partition values are refused, as those values are not in the files.
        """
        table, files = cls(spark, path), Store(spark, source).files()
        if table.versions():
            raise ValueError(f"a table exists at {path}")
        if any("=" in name.rpartition("/")[0].removeprefix(source) for name in files):
            raise ValueError(f"{source} has partition folders")
        schema = spark.read.parquet(source).schema
        properties = dict(properties or {})
        check_properties(schema, properties)
        count = spark.read.schema(schema).parquet(*files).groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")).count()
        rows = {table._key(r["file"]): r["count"] for r in count.collect()}  # a row per file
        found = [(name, size, rows.get(table._key(name), 0)) for name, size in sorted(files.items())]
        if sum(rows.values()) != sum(n for *_, n in found) or len({table._key(name) for name in files}) < len(files):
            raise ValueError(f"files of {source} cannot be told apart by folder and name")
        fragments = [{"id": i, "file": name, "rows": n, "deleted": 0, "bytes": size, "created": 1} for i, (name, size, n) in enumerate(x for x in found if x[2])]
        first = Manifest(1, json.loads(schema.json()), time.time(), "adopt", properties, fragments, next_fragment=len(fragments))
        table.store.write("_versions/00000001.json", json.dumps(first.__dict__), new=True)
        return table

    @property
    def schema(self) -> T.StructType:
        return self.manifest().struct

    def set_properties(self, **properties) -> None:
        if "enable_stable_row_ids" in properties:
            raise ValueError("enable_stable_row_ids can only be set when a table is created")
        base = self.manifest()
        self._commit(base, "properties", properties=base.properties | properties)

    def unset_properties(self, *names: str) -> None:
        base = self.manifest()
        self._commit(base, "properties", properties={k: v for k, v in base.properties.items() if k not in names})

    def set_primary_key(self, *columns: str) -> list[str]:
        base = self.manifest()
        if base.primary_key:
            raise ValueError("the primary key is already set")
        if len(set(columns)) != len(columns):
            raise ValueError("a column is named twice")
        for c in columns:
            if c not in base.struct.names:
                raise ValueError(f"no column {c}")
            if base.struct[c].nullable or isinstance(base.struct[c].dataType, (T.StructType, T.ArrayType, T.MapType)):
                raise ValueError(f"{c} must be a leaf that is not null")
        self._commit(base, "primary key", primary_key=list(columns))
        return list(columns)

    # -- reading ------------------------------------------------------------------

    @property
    def stable_ids(self) -> bool:
        return str(self.manifest().properties.get("enable_stable_row_ids", "false")).lower() == "true"

    def read(self, version: int | None = None, timestamp: float | None = None, where: str | None = None, limit: int | None = None, hidden: tuple[str, ...] = (), fragments: set[int] | None = None, **options) -> DataFrame:
        """The rows of a version, pinned now.

        ``where`` (SQL text) also prunes fragments; ``limit`` alone takes only as many
        fragments as it needs; ``hidden`` adds columns of HIDDEN.
        """
        from tidemark.operators.prune import prune

        opts = ReadOptions(version=version, timestamp=timestamp, **options)
        m = self.manifest(opts.version, opts.timestamp)
        picked = prune(self, m, where) if where and opts.pushDownFilters else None
        if fragments is not None:
            picked = fragments if picked is None else picked & fragments
        if limit is not None and where is None and picked is None:
            picked, left = set(), limit
            for f in m.fragments:
                if left <= 0:
                    break
                picked.add(f["id"])
                left -= f["rows"] - f["deleted"]
        needs = set(hidden) | ({h for h in HIDDEN if where and h in where})
        df = self._scan(m, needs, picked)
        if where:
            df = df.filter(where)
        df = df.select(*m.struct.names, *hidden)
        return df.limit(limit) if limit is not None else df

    def _scan(self, m: Manifest, hidden: set[str], picked: set[int] | None = None) -> DataFrame:
        chosen = [f for f in m.fragments if picked is None or f["id"] in picked]
        names = m.struct.names
        if not chosen:
            empty = self.spark.createDataFrame([], m.struct)
            return empty.withColumns({h: F.lit(None).cast("int" if h == "_fragid" else "long") for h in hidden}) if hidden else empty
        deleted = any(f["deleted"] for f in chosen)
        plain = not hidden and not deleted
        schema = m.struct if plain else T.StructType([*m.struct.fields, *STORED.fields])
        files = [(name, f["id"], f["created"], first) for f in chosen for name, first, _ in pieces(f)]
        df = self.spark.read.schema(schema).parquet(*[self.store.path(f[0]) for f in files])
        if plain:
            return df
        known = self.spark.createDataFrame([(self._key(name), *rest) for name, *rest in files], "__file string, _fragid int, __version long, __first long")
        known = F.broadcast(known) if len(files) <= BROADCAST_ROWS else known
        df = df.select("*", F.substring_index("_metadata.file_path", "/", -2).alias("__file"), F.col("_metadata.row_index").alias("__index")).join(known, "__file")
        df = df.withColumn("_rowaddr", F.shiftleft(F.col("_fragid").cast("long"), 32) + F.col("__first") + F.col("__index"))
        if deleted:
            gone = self.deleted(m, sum(f["deleted"] for f in m.fragments))
            df = df.join(gone, F.col("_rowaddr") == F.col("rowaddr"), "left_anti")
        stable = str(m.properties.get("enable_stable_row_ids", "false")).lower() == "true"
        made = {
            "_rowaddr": F.col("_rowaddr"),
            "_fragid": F.col("_fragid"),
            "__first": F.col("__first"),
            "_rowid": F.coalesce("__rowid", "_rowaddr") if stable else F.col("_rowaddr"),
            "_row_created_at_version": F.coalesce("__created", "__version"),
            "_row_last_updated_at_version": F.coalesce("__updated", "__version"),
        }
        return df.select(*names, *[made[h].alias(h) for h in hidden])

    def deleted(self, m: Manifest, count: int) -> DataFrame:
        """Addresses of a version's deleted rows; to be broadcast if they are at most so many."""
        gone = self.spark.read.schema("rowaddr long").parquet(*[self.store.path(d) for d in m.deletes])
        return F.broadcast(gone) if count <= BROADCAST_ROWS else gone

    def count(self, where: str | None = None, version: int | None = None) -> int:
        """From the manifest alone where there is no condition."""
        return self.manifest(version).rows if where is None else self.read(version=version, where=where).count()

    def changes(self, since: int, until: int | None = None) -> DataFrame:
        """Rows created or updated after version ``since``, with both version columns and ``change``."""
        cdf = ("_row_created_at_version", "_row_last_updated_at_version")
        rows = self.read(version=until, hidden=cdf).filter(F.greatest(*cdf) > since)
        return rows.withColumn("change", F.when(F.col(cdf[0]) > since, "insert").otherwise("update"))

    def history(self) -> DataFrame:
        rows = [(m.version, m.timestamp, m.operation, m.rows, len(m.fragments)) for m in map(self.manifest, self.versions())]
        return self.spark.createDataFrame(rows, "version long, timestamp double, operation string, rows long, fragments int")

    def scan_report(self, where: str | None = None, version: int | None = None) -> dict:
        from tidemark.operators.prune import prune

        m = self.manifest(version)
        picked = prune(self, m, where) if where else None
        kept = [f for f in m.fragments if picked is None or f["id"] in picked]
        return {"version": m.version, "fragments": len(m.fragments), "scanned_fragments": len(kept), "rows": m.rows, "scanned_rows": sum(f["rows"] - f["deleted"] for f in kept), "bytes": max(1, sum(f["bytes"] for f in kept))}

    def statistics(self, where: str | None = None, columns: list[str] | None = None, version: int | None = None) -> dict[str, int]:
        """Rows and bytes of a scan: those of the fragments that the condition leaves, bytes by the share of the columns' width."""
        report = self.scan_report(where, version)
        fields = self.manifest(report["version"]).struct.fields
        width = lambda f: _WIDTHS.get(f.dataType.typeName(), 20)
        whole = sum(map(width, fields))
        share = sum(width(f) for f in fields if columns is None or f.name in columns) / whole if whole else 1
        return {"rows": report["scanned_rows"], "bytes": max(1, int(report["bytes"] * share))}

    def _key(self, file: str) -> str:
        """The last two parts of a file's path as Spark names them (file names alone repeat between shards)."""
        if "=" in file:
            file = self.store._path(file).toUri().toString()
        return "/".join(file.split("/")[-2:])

    # -- writing ------------------------------------------------------------------

    def _write(self, df: DataFrame, m: Manifest, stored: bool = False, **options) -> list[dict]:
        """Write fragments (not visible yet); their entries without ids."""
        opts = WriteOptions(**options)
        df = df if stored else check_rows(df, m.struct, m.properties)
        shard = m.sharding
        if opts.fragment_count is not None and (opts.fragment_count < 1 or shard):
            raise ValueError("fragment_count must be positive, and a sharded table has a fragment per file")
        if shard:
            from tidemark.functions.scalar import bucket

            key = bucket(shard[1], F.col(shard[2])) if shard[0] == "bucket" else F.col(shard[1])
            parts = shard[1] if shard[0] == "bucket" else int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            df = df.withColumn("__shard", key.cast("string"))
            tasks = tasks_for(input_bytes(df))
            if tasks > (parts if shard[0] == "bucket" else 1):  # a shard's rows go to several tasks, and a task has few shards
                own = [f.name for f in m.struct if isinstance(f.dataType, (T.NumericType, T.StringType, T.DateType, T.TimestampType))]
                df = df.repartitionByRange(tasks, F.asc_nulls_first("__shard"), F.xxhash64(*own or [F.lit(0)]))
            else:
                df = df.repartition(parts, "__shard")
            df = df.sortWithinPartitions(F.asc_nulls_first("__shard"))
        place = f"data/{uuid.uuid4().hex}"
        writer = df.write.option("maxRecordsPerFile", opts.max_row_per_file)
        (writer.partitionBy("__shard") if shard else writer).parquet(self.store.path(place))
        files = {k: v for k, v in self.store.walk(place).items() if k.endswith(".parquet")}
        if not files:
            return []
        rows = self._rows_of(m.struct, files)
        out = []
        for name, size in sorted(files.items(), key=lambda x: (x[0].rpartition("/")[0], _place(x[0]))):
            if n := rows.get(self._key(name), 0):
                entry = {"file": name, "rows": n, "deleted": 0, "bytes": size}
                if shard:
                    entry["shard"] = name.split("__shard=")[1].split("/")[0]
                out.append(entry)
        return _grouped(out, opts.fragment_count) if opts.fragment_count else out

    def _rows_of(self, struct: T.StructType, files) -> dict[str, int]:
        """Rows of written files, by key."""
        read = self.spark.read.schema(T.StructType([*struct.fields, *STORED.fields])).parquet(*[self.store.path(k) for k in files])
        return {r[0]: r[1] for r in read.groupBy(F.substring_index("_metadata.file_path", "/", -2)).count().collect()}

    def append(self, df: DataFrame, **options) -> Manifest:
        base = self.manifest()
        return self._commit_rows(base, "append", self._write(df, base, **options))

    def overwrite(self, df: DataFrame, properties: dict | None = None, sharding: list | None = None, **options) -> Manifest:
        """Replaces rows and schema in one commit."""
        base = self.manifest()
        made = replace(base, schema=json.loads(df.schema.json()), properties=base.properties | (properties or {}), sharding=sharding or base.sharding)
        check_properties(made.struct, made.properties)
        added = self._write(df, made, **options)
        new = [dict(f, id=base.next_fragment + i, created=base.version + 1) for i, f in enumerate(added)]
        return self._commit(base, "overwrite", schema=made.schema, properties=made.properties, sharding=made.sharding, fragments=new, deletes=[], next_fragment=base.next_fragment + len(new), indexes={})

    def _drop_rows(self, base: Manifest, rows: DataFrame) -> tuple[dict[int, int], list[str]]:
        """Write the addresses (column ``_rowaddr``) of rows to delete; how many each fragment loses."""
        place = f"deletes/{uuid.uuid4().hex}"
        rows.select(F.col("_rowaddr").alias("rowaddr")).write.parquet(self.store.path(place))
        gone = self.spark.read.schema("rowaddr long").parquet(self.store.path(place))
        lost = {r[0]: r[1] for r in gone.groupBy(F.shiftrightunsigned("rowaddr", 32)).count().collect()}
        return lost, [place] if lost else []

    def delete(self, where: str | None = None) -> Manifest:
        from tidemark.operators.prune import prune

        base = self.manifest()
        rows = self._scan(base, {"_rowaddr"}, prune(self, base, where) if where else None)
        lost, place = self._drop_rows(base, rows.filter(where) if where else rows)
        return self._commit_rows(base, "delete", [], lost, place, set(lost)) if lost else base

    def update(self, values: dict[str, str | Column], where: str | None = None) -> Manifest:
        """Rewrites the matching rows; with stable ids they keep their id and creation version."""
        base = self.manifest()
        names = base.struct.names
        rows = self._scan(base, set(HIDDEN))
        rows = rows.filter(where) if where else rows
        if missing := set(values) - set(names):
            raise ValueError(f"no column {sorted(missing)}")
        lost, place = self._drop_rows(base, rows)
        if not lost:
            return base
        changed = {c: (F.expr(v) if isinstance(v, str) else v).cast(base.struct[c].dataType) for c, v in values.items()}
        new = rows.select(*[changed.get(c, F.col(c)).alias(c) for c in names], F.col("_rowid").alias("__rowid"), F.col("_row_created_at_version").alias("__created"), F.lit(None).cast("long").alias("__updated"))  # the version that the commit gets, whatever comes before it
        new = new if self.stable_ids else new.withColumn("__rowid", F.lit(None).cast("long"))
        return self._commit_rows(base, "update", self._write(new, base, stored=True), lost, place, set(lost))

    def merge(self, source: DataFrame, on: str, matched: list[tuple[str | None, dict | None]] = (), not_matched: list[tuple[str | None, dict]] = ()) -> Manifest:
        """``on``, conditions and values are SQL over ``t`` (table) and ``s`` (source).

        ``matched``: (condition, values to set or None to delete), the first that holds;
        ``not_matched``: (condition, values to insert).  A row that is matched twice is
        an error.  Updated rows are new rows: new id, both versions are the merge's.
        """
        base = self.manifest()
        names = base.struct.names
        # the source is read several times: it is written once, so that all reads see the same rows
        staged = f"staging/{uuid.uuid4().hex}"
        source.write.parquet(self.store.path(staged))
        source = self.spark.read.schema(source.schema).parquet(self.store.path(staged))
        try:
            return self._merge(base, names, source, on, matched, not_matched)
        finally:
            self.store.delete(staged)

    def _merge(self, base: Manifest, names: list[str], source: DataFrame, on: str, matched: list, not_matched: list) -> Manifest:
        target = self._scan(base, {"_rowaddr"}).alias("t")
        joined = source.withColumn("__there", F.lit(True)).alias("s").join(target, F.expr(on), "left")
        hit = F.col("t._rowaddr").isNotNull()
        action = F.lit(-1)
        for i, (condition, _) in reversed(list(enumerate(matched))):
            action = F.when(hit & (F.expr(condition) if condition else F.lit(True)), i).otherwise(action)
        for i, (condition, _) in reversed(list(enumerate(not_matched))):
            action = F.when(~hit & (F.expr(condition) if condition else F.lit(True)), 100 + i).otherwise(action)

        def pick(column: str) -> Column:
            out = F.lit(None).cast(base.struct[column].dataType)
            for i, (_, values) in enumerate(matched):
                if values is not None:
                    value = F.expr(values[column]) if column in values else F.col(f"t.{column}")
                    out = F.when(F.col("__action") == i, value.cast(base.struct[column].dataType)).otherwise(out)
            for i, (_, values) in enumerate(not_matched):
                if column in values:
                    out = F.when(F.col("__action") == 100 + i, F.expr(values[column]).cast(base.struct[column].dataType)).otherwise(out)
            return out.alias(column)

        planned = joined.withColumn("__action", action).filter("__action >= 0")
        lost, place = self._drop_rows(base, planned.filter("t._rowaddr is not null").select(F.col("t._rowaddr").alias("_rowaddr")))
        if place:
            gone = self.spark.read.parquet(self.store.path(place[0]))
            if gone.groupBy("rowaddr").count().filter("count > 1").limit(1).count():
                raise ValueError("a row of the table matches several rows of the source")
        keeps = [i for i, (_, values) in enumerate(matched) if values is not None] + [100 + i for i in range(len(not_matched))]
        new = planned.filter(F.col("__action").isin(keeps)).select(*[pick(c) for c in names])
        added = self._write(new, base) if keeps else []
        return self._commit_rows(base, "merge", added, lost, place, set(lost)) if lost or added else base

    def _backfill(self, view: DataFrame, columns: list[str], struct: T.StructType, fill) -> Manifest:
        base = self.manifest()
        if missing := {"_rowaddr", "_fragid"} - set(view.columns):
            raise ValueError(f"the view needs {sorted(missing)}")
        names = base.struct.names
        if view.filter("_rowaddr is not null").groupBy("_rowaddr").count().filter("count > 1").limit(1).count():
            raise ValueError("a row address stands in the view more than once")
        own = view.select(F.col("_rowaddr").alias("__addr"), F.lit(True).alias("__hit"), *[F.col(c).alias(f"__new_{c}") for c in columns])
        rows = self._scan(base, {*HIDDEN, "__first"})
        joined = rows.join(own, rows["_rowaddr"] == own["__addr"], "left")
        stored = [F.col("_rowid").alias("__rowid") if self.stable_ids else F.lit(None).cast("long").alias("__rowid"), F.col("_row_created_at_version").alias("__created"), F.col("_row_last_updated_at_version").alias("__updated")]
        new = joined.select(*[fill(f.name) if f.name in columns else F.col(f.name) for f in struct], *stored, "_rowaddr", F.concat_ws("-", "_fragid", "__first").alias("__frag"))
        # fragments keep their ids, files and row order, so addresses stay
        live = [f for f in base.fragments]
        parts = sum(len(pieces(f)) for f in live)
        place = f"data/{uuid.uuid4().hex}"
        new.repartition(max(1, parts), "__frag").sortWithinPartitions("__frag", "_rowaddr").drop("_rowaddr").write.partitionBy("__frag").parquet(self.store.path(place))
        files: dict[int, dict[int, tuple[str, int]]] = {}
        for name, size in self.store.walk(place).items():
            if name.endswith(".parquet"):
                of, first = map(int, name.split("__frag=")[1].split("/")[0].split("-"))
                if files.setdefault(of, {}).setdefault(first, (name, size)) != (name, size):
                    raise RuntimeError("a file was written as several files")
        worn = [x[0] for f in live if f["deleted"] and f.get("files") for x in files.get(f["id"], {}).values()]
        left = self._rows_of(struct, worn) if worn else {}
        # rows deleted before are left out of the new files: addresses of the rest move, so such fragments get new ids
        made, fresh, next_id = [], [], base.next_fragment
        for f in live:
            if f["id"] not in files:
                continue
            own = files[f["id"]]
            entry = dict(f, bytes=sum(size for _, size in own.values()), rows=f["rows"] - f["deleted"], deleted=0)
            if f.get("files"):
                rows_of = {first: n for _, first, n in pieces(f)}
                entry["files"] = [[name, left[self._key(name)] if f["deleted"] else rows_of[first]] for first, (name, _) in sorted(own.items())]
            else:
                entry["file"] = own[0][0]
            if f["deleted"]:
                fresh.append(entry | {"id": next_id})
                next_id += 1
            else:
                made.append(entry)
        return self._commit(base, "backfill", schema=json.loads(struct.json()), fragments=made + fresh, deletes=[], next_fragment=next_id, indexes={k: v for k, v in base.indexes.items() if v["column"].split(".")[0] not in columns and not fresh})

    def add_columns_from(self, view: DataFrame, columns: list[str] | None = None) -> Manifest:
        """New columns by row address; rows that the view doesn't cover get null."""
        base = self.manifest()
        columns = columns or [c for c in view.columns if c not in ("_rowaddr", "_fragid")]
        if there := set(columns) & set(base.struct.names):
            raise ValueError(f"columns exist: {sorted(there)}")
        struct = T.StructType([*base.struct.fields, *[T.StructField(c, view.schema[c].dataType, True) for c in columns]])
        return self._backfill(view, columns, struct, lambda c: F.col(f"__new_{c}").alias(c))

    def update_columns_from(self, view: DataFrame, columns: list[str] | None = None) -> Manifest:
        """Values of existing columns by row address; rows that the view doesn't cover keep theirs."""
        base = self.manifest()
        columns = columns or [c for c in view.columns if c not in ("_rowaddr", "_fragid")]
        if missing := set(columns) - set(base.struct.names):
            raise ValueError(f"no column {sorted(missing)}")
        return self._backfill(view, columns, base.struct, lambda c: F.when(F.col("__hit"), F.col(f"__new_{c}").cast(base.struct[c].dataType)).otherwise(F.col(c)).alias(c))

    # -- maintenance --------------------------------------------------------------

    def optimize(self, target_rows_per_fragment: int = MAX_ROWS_PER_FILE, materialize_deletions: bool = True, materialize_deletions_threshold: float = 0.1, **ignored) -> dict[str, int]:
        """Rewrite small fragments, and those that lost many rows, into larger ones."""
        base = self.manifest()
        small = [f for f in base.fragments if f["rows"] - f["deleted"] < target_rows_per_fragment]
        worn = [f for f in base.fragments if materialize_deletions and f["deleted"] > materialize_deletions_threshold * f["rows"]]
        picked = {f["id"]: f for f in (small if len(small) > 1 else []) + worn}
        if not picked:
            return dict.fromkeys(("fragments_removed", "fragments_added", "files_removed", "files_added"), 0)
        rows = sum(f["rows"] - f["deleted"] for f in picked.values())
        df = self._scan(base, set(HIDDEN), set(picked))
        keep = [F.col("_rowid").alias("__rowid") if self.stable_ids else F.lit(None).cast("long").alias("__rowid"), F.col("_row_created_at_version").alias("__created"), F.col("_row_last_updated_at_version").alias("__updated")]
        df = df.select(*base.struct.names, *keep)
        df = df if base.sharding else df.repartition(max(1, -(-rows // target_rows_per_fragment)))
        added = [dict(f, id=base.next_fragment + i, created=base.version + 1) for i, f in enumerate(self._write(df, base, stored=True, max_row_per_file=target_rows_per_fragment))]
        rest = [f for f in base.fragments if f["id"] not in picked]
        files = sum(f["deleted"] > 0 for f in picked.values())
        # indexes go on covering the other fragments; the new ones are scanned
        indexes = {k: dict(v, fragments=[f for f in v["fragments"] if f not in picked]) for k, v in base.indexes.items()}
        self._commit(base, "optimize", fragments=rest + added, deletes=base.deletes if any(f["deleted"] for f in rest) else [], next_fragment=base.next_fragment + len(added), indexes=indexes)
        return {"fragments_removed": len(picked), "fragments_added": len(added), "files_removed": len(picked) + files, "files_added": len(added)}

    def vacuum(self, before_version: int | None = None, before_timestamp_millis: int | None = None, delete_unverified: bool = False, error_if_tagged_old_versions: bool = True) -> dict[str, int]:
        """Delete old versions, and the files that only they needed.

        Files that no version ever named may belong to a commit that is still being
        written: they go only with ``delete_unverified``, or when they are UNVERIFIED_DAYS old.
        """
        known = self.versions()
        old = [v for v in known[:-1] if (before_version is None or v < before_version) and (before_timestamp_millis is None or self.manifest(v).timestamp * 1000 < before_timestamp_millis)]
        tagged = {t["version"] for t in self.refs()["tags"].values()}
        if error_if_tagged_old_versions and tagged & set(old):
            raise ValueError(f"tagged versions: {sorted(tagged & set(old))}")
        old = [v for v in old if v not in tagged]
        named = self._named(old)
        freed = 0
        for v in old:
            name = f"{self._folder}/{v:08d}.json"
            freed += self.store.list(self._folder)[f"{v:08d}.json"]
            self.store.delete(name)
        owners = [Table(self.spark, self.path), *(Table(self.spark, self.path, b) for b in self.refs()["branches"])]
        used = set().union(*(t._named(t.versions()) for t in owners))
        within = lambda name, places: name in places or any("/".join(name.split("/")[:i]) in places for i in range(1, name.count("/") + 1))
        for top in ("data", "deletes", "index"):
            for name, size in self.store.walk(top).items():
                if not within(name, used) and (delete_unverified or within(name, named) or self.store.age(name) > UNVERIFIED_DAYS * 86400):
                    freed += size
                    self.store.delete(name)
        return {"bytes_removed": freed, "old_versions": len(old)}

    def _named(self, versions: list[int]) -> set[str]:
        """Files and folders that these versions name."""
        out: set[str] = set()
        for m in map(self.manifest, versions):
            out |= {name for f in m.fragments for name, *_ in pieces(f)} | set(m.deletes) | {i[k] for i in m.indexes.values() for k in ("place", "lengths") if i.get(k)}
        return out

    # -- branches and tags --------------------------------------------------------

    def refs(self) -> dict:
        return self.store.state("_refs", {"branches": {}, "tags": {}})[1]

    def _change_refs(self, kind: str, name: str, entry: dict | None) -> None:
        """Add a branch or tag that isn't there, or take one out."""

        def how(refs: dict) -> None:
            if entry is None:
                refs[kind].pop(name, None)
            elif refs[kind].setdefault(name, entry) is not entry:
                raise ValueError(f"{name} exists")

        self.store.change("_refs", {"branches": {}, "tags": {}}, how)

    def _resolve(self, version: int | None, branch: str | None, tag: str | None) -> tuple[str | None, int]:
        refs = self.refs()
        if tag is not None:
            if tag not in refs["tags"]:
                raise ValueError(f"no tag {tag}")
            return refs["tags"][tag]["branch"], refs["tags"][tag]["version"]
        if branch is not None and branch not in refs["branches"]:
            raise ValueError(f"no branch {branch}")
        return branch, Table(self.spark, self.path, branch).manifest(version).version

    def create_branch(self, name: str, version: int | None = None, branch: str | None = None, tag: str | None = None, exist_ok: bool = False) -> Table:
        refs = self.refs()
        if name in refs["branches"]:
            if not exist_ok:
                raise ValueError(f"branch {name} exists")
            return Table(self.spark, self.path, name)
        parent, at = self._resolve(version, branch, tag)
        text = json.dumps(Table(self.spark, self.path, parent).manifest(at).__dict__)
        made = Table(self.spark, self.path, name)
        made.store.write(f"{made._folder}/{at:08d}.json", text, new=True)
        self._change_refs("branches", name, {"parent_branch": parent, "parent_version": at, "created_at": int(time.time()), "manifest_size": len(text)})
        return made

    def create_tag(self, name: str, version: int | None = None, branch: str | None = None, tag: str | None = None, exist_ok: bool = False) -> None:
        refs = self.refs()
        if name in refs["tags"]:
            if not exist_ok:
                raise ValueError(f"tag {name} exists")
            return
        owner, at = self._resolve(version, branch, tag)
        now, size = int(time.time()), len(json.dumps(Table(self.spark, self.path, owner).manifest(at).__dict__))
        self._change_refs("tags", name, {"branch": owner, "version": at, "created_at": now, "updated_at": now, "manifest_size": size})

    def drop_ref(self, kind: str, name: str, missing_ok: bool = False) -> None:
        refs = self.refs()
        if name not in refs[kind]:
            if missing_ok:
                return
            raise ValueError(f"no {kind[:-1]} {name}")
        if kind == "branches":
            self.store.delete(f"_branches/{name}")
        self._change_refs(kind, name, None)

    def show_branches(self) -> DataFrame:
        rows = [(k, v["parent_branch"], v["parent_version"], v["created_at"], v["manifest_size"]) for k, v in sorted(self.refs()["branches"].items())]
        return self.spark.createDataFrame(rows, "name string, parent_branch string, parent_version long, created_at long, manifest_size int")

    def show_tags(self) -> DataFrame:
        rows = [(k, v["branch"], v["version"], v["created_at"], v["updated_at"], v["manifest_size"]) for k, v in sorted(self.refs()["tags"].items())]
        return self.spark.createDataFrame(rows, "name string, branch string, version long, created_at long, updated_at long, manifest_size int")
