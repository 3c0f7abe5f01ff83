"""Namespaces and tables in a warehouse folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.sources.store import Store
from tidemark.sources.table import Table

FUNCTIONS = ("bucket", "fragment_or_rand", "match", "match_phrase", "multi_match")


class Catalog:
    """The registry is a row of numbered JSON files per namespace, of which the last counts; a table is a folder anywhere."""

    def __init__(self, spark: SparkSession, warehouse: str, default: str = "default"):
        self.spark, self.warehouse, self.default = spark, warehouse.rstrip("/"), default
        self.store = Store(spark, self.warehouse)
        if not self.namespace_exists(default):
            self.create_namespace(default)

    def _folder(self, namespace: str) -> str:
        return f"{namespace}/_namespace"

    def _load(self, namespace: str) -> dict:
        if not self.namespace_exists(namespace):
            raise ValueError(f"no namespace {namespace}")
        return self.store.state(self._folder(namespace), {})[1]

    def _change(self, namespace: str, how: Callable[[dict], None]) -> None:
        self.store.change(self._folder(namespace), {"properties": {}, "tables": {}}, how)

    def create_namespace(self, name: str, properties: dict | None = None, exist_ok: bool = False) -> None:
        if self.namespace_exists(name):
            if not exist_ok:
                raise ValueError(f"namespace {name} exists")
            return
        self._change(name, lambda entry: entry["properties"].update(properties or {}))

    def drop_namespace(self, name: str, cascade: bool = False) -> None:
        if self._load(name)["tables"] and not cascade:
            raise ValueError(f"namespace {name} is not empty")
        for t in list(self._load(name)["tables"]):
            self.drop_table(f"{name}.{t}", purge=True)
        self.store.delete(name)

    def namespace_exists(self, name: str) -> bool:
        return self.store.exists(self._folder(name))

    def list_namespaces(self) -> list[str]:
        found = self.store.fs.listStatus(self.store._path(""))
        return sorted(n for x in found if x.isDirectory() and self.namespace_exists(n := x.getPath().getName()))

    def describe_namespace(self, name: str) -> dict:
        return self._load(name)["properties"]

    def _split(self, name: str) -> tuple[str, str]:
        namespace, _, table = name.rpartition(".")
        return namespace.rpartition(".")[2] or self.default, table

    @staticmethod
    def is_path(name: str) -> bool:
        return "/" in name or "://" in name

    def path(self, name: str) -> str:
        if self.is_path(name):
            return name
        namespace, table = self._split(name)
        entry = self._load(namespace)["tables"]
        if table not in entry:
            raise ValueError(f"no table {name}")
        return entry[table]

    def table(self, name: str) -> Table:
        return Table(self.spark, self.path(name))

    def table_exists(self, name: str) -> bool:
        try:
            return bool(self.table(name).versions())
        except ValueError:
            return False

    def list_tables(self, namespace: str | None = None) -> list[str]:
        return sorted(self._load(namespace or self.default)["tables"])

    def _register(self, name: str, path: str) -> None:
        namespace, table = self._split(name)
        self._load(namespace)

        def add(entry: dict) -> None:
            if table in entry["tables"]:
                raise ValueError(f"table {name} exists")
            entry["tables"][table] = path

        self._change(namespace, add)

    def _place(self, name: str, location: str | None) -> str:
        namespace, table = self._split(name)
        return location or f"{self.warehouse}/{namespace}/{table}"

    def create_table(self, name: str, schema: T.StructType, properties: dict | None = None, sharding: list | None = None, location: str | None = None) -> Table:
        """With a location that holds a table already, that table is registered as it is."""
        path = self._place(name, location)
        self._register(name, path)
        try:
            return Table.create(self.spark, path, schema, properties, sharding, exist_ok=location is not None)
        except Exception:
            self._forget(name)
            raise

    def create_table_as(self, name: str, df: DataFrame, properties: dict | None = None, sharding: list | None = None, location: str | None = None, replace_table: bool = False) -> Table:
        there = self.table_exists(name)
        if there and replace_table:
            return Table.create_as(self.spark, self.path(name), df, properties, sharding, replace_table=True)
        path = self._place(name, location)
        self._register(name, path)
        try:
            return Table.create_as(self.spark, path, df, properties, sharding)
        except Exception:
            self._forget(name)
            raise

    def _forget(self, name: str) -> None:
        namespace, table = self._split(name)
        self._change(namespace, lambda entry: entry["tables"].pop(table, None))

    def drop_table(self, name: str, purge: bool = False) -> None:
        """Forgets the table; with ``purge`` (and for a path) its files go too."""
        path = self.path(name)
        if purge or self.is_path(name):
            Store(self.spark, path).delete("")
        if not self.is_path(name):
            self._forget(name)

    def rename_table(self, name: str, to: str) -> None:
        path = self.path(name)
        self._register(to, path)
        self._forget(name)

    def describe_table(self, name: str) -> DataFrame:
        t = self.table(name)
        m = t.manifest()
        rows = [(f.name, f.dataType.simpleString(), "" if f.nullable else "not null") for f in m.struct]
        rows += [("# Location", t.path, ""), ("# Version", str(m.version), ""), ("# Rows", str(m.rows), "")]
        return self.spark.createDataFrame(rows, "col_name string, data_type string, comment string")
