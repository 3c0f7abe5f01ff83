"""The short name ``tidemark`` for ``spark.read.format``: a Python data source over a table's fragments.

A task reads one file of a fragment in Arrow batches and leaves out its deleted rows.  Spark
gives Python sources neither columns nor filters to push, so ``Table.read``, a native
Parquet scan, is the way for large queries; this one is for tools that know formats only.
Files are opened through pyarrow's file systems (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.sources.table import pieces

OPTIONS = ("path", "version", "batch_size")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TidemarkSource)


def _open(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def _manifest(options: dict) -> dict:
    from pyarrow import fs

    store, root = _open(options["path"].rstrip("/"))
    names = [f.base_name for f in store.get_file_info(fs.FileSelector(f"{root}/_versions", allow_not_found=True)) if f.base_name.endswith(".json")]
    if not names:
        raise ValueError(f"no table at {options['path']}")
    name = f"{int(options['version']):08d}.json" if "version" in options else max(names)
    if name not in names:
        raise ValueError(f"version {options['version']} does not exist")
    with store.open_input_file(f"{root}/_versions/{name}") as f:
        return json.loads(f.read())


@dataclass
class Fragment(InputPartition):
    id: int
    file: str
    first: int
    rows: int
    deletes: list[str]


class TidemarkSource(DataSource):
    """Options: ``path`` (also of ``load``), ``version``, ``batch_size`` (rows of an Arrow batch)."""

    def __init__(self, options):
        super().__init__(options)
        if unknown := {k.lower() for k in options} - set(OPTIONS):
            raise ValueError(f"unknown options {sorted(unknown)}")
        if "path" not in options:
            raise ValueError("the path of a table is required")
        self.found = _manifest(options)

    @classmethod
    def name(cls) -> str:
        return "tidemark"

    def schema(self) -> T.StructType:
        return T.StructType.fromJson(self.found["schema"])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return FragmentReader(self.options["path"].rstrip("/"), self.found, schema, int(self.options.get("batch_size", 8192)))


class FragmentReader(DataSourceReader):
    def __init__(self, root: str, manifest: dict, schema: T.StructType, rows: int):
        self.root, self.manifest, self.wanted, self.rows = root, manifest, schema, rows

    def partitions(self) -> list[Fragment]:
        deletes = self.manifest["deletes"]
        return [Fragment(f["id"], name, first, rows, deletes if f["deleted"] else []) for f in self.manifest["fragments"] for name, first, rows in pieces(f)]

    def read(self, fragment: Fragment):
        import numpy as np
        import pyarrow as pa
        import pyarrow.dataset as ds
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema

        at = lambda name: name if "://" in name or name.startswith(("/", "file:")) else f"{self.root}/{name}"
        target = to_arrow_schema(self.wanted)
        gone = np.empty(0, np.int64)
        first = (fragment.id << 32) + fragment.first
        if fragment.deletes:
            within = (ds.field("rowaddr") >= first) & (ds.field("rowaddr") < first + fragment.rows)
            places = [_open(at(d)) for d in fragment.deletes]
            gone = np.concatenate([ds.dataset(root, filesystem=store, format="parquet").to_table(filter=within)["rowaddr"].to_numpy() for store, root in places]) - first
        store, name = _open(at(fragment.file))
        with store.open_input_file(name) as handle:
            file, row = pq.ParquetFile(handle), 0
            there = [f.name for f in target if f.name in file.schema_arrow.names]
            for batch in file.iter_batches(self.rows, columns=there):
                kept = ~np.isin(np.arange(row, row + batch.num_rows), gone)
                row += batch.num_rows
                batch = batch.filter(pa.array(kept))
                columns = [self._cast(batch[f.name], f.type) if f.name in there else pa.nulls(batch.num_rows, f.type) for f in target]
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays(columns, schema=target)

    @staticmethod
    def _cast(column, kind):
        import pyarrow as pa

        if pa.types.is_timestamp(column.type) and pa.types.is_timestamp(kind) and column.type.unit == "ns":
            column = column.cast(pa.timestamp("us", column.type.tz), safe=False)
        return column.cast(kind)
