"""Files of a table through Hadoop's FileSystem, so any store that Spark reads will do."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


class Conflict(Exception):
    """Another writer committed first."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def path(self, name: str) -> str:
        """A file's place; adopted files are named in full."""
        return name if "://" in name or name.startswith(("/", "file:")) else f"{self.root}/{name}"

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self._path(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str, new: bool = False) -> None:
        """Readers see the whole file or none.  ``new``: fails if the file is there.

        The text is written aside and takes its name at once: by a hard link on local
        files, by a rename that doesn't replace elsewhere (exclusive on HDFS).
        """
        if new and self.exists(name):
            raise Conflict(name)
        aside = f"{name}.{uuid.uuid4().hex}.tmp"
        out = self.fs.create(self._path(aside), True)
        out.write(bytearray(text, "utf-8"))
        out.close()
        hadoop = self.jvm.org.apache.hadoop.fs
        qualified = self.fs.makeQualified(self._path(name))
        try:
            if new and qualified.toUri().getScheme() == "file":
                local = lambda n: self.jvm.java.io.File(self.fs.makeQualified(self._path(n)).toUri().getPath()).toPath()
                self.jvm.java.nio.file.Files.createLink(local(name), local(aside))
            else:
                option = self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
                kinds = self.jvm.java.lang.reflect.Array.newInstance(option, 1)
                kinds[0] = option.getEnumConstants()[0 if new else 1]  # NONE, OVERWRITE
                hadoop.FileContext.getFileContext(qualified.toUri(), self.conf).rename(self.fs.makeQualified(self._path(aside)), qualified, kinds)
        except Exception as e:
            if new and "Exists" in str(e):
                raise Conflict(name) from e
            raise
        finally:
            if self.exists(aside):
                self.fs.delete(self._path(aside), False)

    def state(self, folder: str, empty: dict) -> tuple[int, dict]:
        """The latest of a folder's numbered states."""
        known = sorted(int(n[:-5]) for n in self.list(folder) if n.endswith(".json"))
        return (known[-1], json.loads(self.read(f"{folder}/{known[-1]:08d}.json"))) if known else (0, empty)

    def change(self, folder: str, empty: dict, how: Callable[[dict], None]) -> dict:
        """Apply a change to a numbered state; if another writer was first, to what that one left."""
        while True:
            n, found = self.state(folder, json.loads(json.dumps(empty)))
            how(found)
            try:
                self.write(f"{folder}/{n + 1:08d}.json", json.dumps(found), new=True)
            except Conflict:
                continue
            if n > 10:
                self.delete(f"{folder}/{n - 10:08d}.json")
            return found

    def list(self, name: str) -> dict[str, int]:
        """Names and sizes of the files of a folder."""
        if not self.exists(name):
            return {}
        return {x.getPath().getName(): x.getLen() for x in self.fs.listStatus(self._path(name)) if x.isFile()}

    def stamps(self, name: str) -> dict[str, tuple[int, int]]:
        """Sizes and times of the files of a folder."""
        if not self.exists(name):
            return {}
        return {x.getPath().getName(): (x.getLen(), x.getModificationTime()) for x in self.fs.listStatus(self._path(name)) if x.isFile()}

    def files(self) -> dict[str, int]:
        """Full paths and sizes of all files below the root, or of the root if it is a file; hidden ones are left out."""
        out, found = {}, self.fs.listFiles(self._path(""), True)
        while found.hasNext():
            x = found.next()
            if x.getPath().getName()[0] not in "._":
                out[x.getPath().toString()] = x.getLen()
        return out

    def walk(self, name: str) -> dict[str, int]:
        if not self.exists(name):
            return {}
        out, found = {}, self.fs.listFiles(self._path(name), True)
        base = self.fs.makeQualified(self._path("")).toString().rstrip("/")
        while found.hasNext():
            x = found.next()
            out[x.getPath().toString().removeprefix(base).lstrip("/")] = x.getLen()
        return out

    def age(self, name: str) -> float:
        """Seconds since a file was written."""
        return (self.jvm.java.lang.System.currentTimeMillis() - self.fs.getFileStatus(self._path(name)).getModificationTime()) / 1000

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def rename(self, name: str, to: str) -> None:
        self.fs.rename(self._path(name), self._path(to))
