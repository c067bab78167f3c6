"""Index tables in a shared folder: generations behind a pointer, metadata, a single-writer lock, an error log.

All files are reached through Hadoop's file systems, so the root may be a local folder or any URI that Spark can write.
"""

from __future__ import annotations

import json
import os
import socket
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from siftline.functions.constants import SCHEMA_VERSION
from siftline.runtime import laid_out

#: Appended parts of a table after which it is written anew as one.
MAX_PARTS = 64
#: Seconds after which a lock of another host counts as left behind.
LOCK_AGE = 6 * 3600


class LockHeld(RuntimeError):
    """Another process is writing (exit code 2 of a command line)."""


class Files:
    """The few file operations that a store needs, on any Hadoop file system."""

    def __init__(self, root: str):
        self.spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        self.jvm = self.spark._jvm
        self.conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _fs(self):
        return self.path("").getFileSystem(self.conf)

    def make(self) -> None:
        self._fs().mkdirs(self.path(""))

    def text(self, name: str) -> str | None:
        fs, path = self._fs(), self.path(name)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str, overwrite: bool = False) -> None:
        """A new file; one that exists is an error unless ``overwrite``."""
        stream = self._fs().create(self.path(name), overwrite)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def replace(self, source: str, target: str) -> None:
        """Rename over what is there, in one step."""
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        source, target = (self._fs().makeQualified(self.path(x)) for x in (source, target))
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.conf).rename(source, target, options)

    def move(self, source: str, target: str) -> bool:
        return self._fs().rename(self.path(source), self.path(target))

    def remove(self, name: str) -> None:
        self._fs().delete(self.path(name), True)

    def names(self, folder: str) -> list[str]:
        path = self.path(folder)
        return sorted(s.getPath().getName() for s in self._fs().listStatus(path)) if self._fs().exists(path) else []


class Store:
    """Tables under a root, each in folders of its own; the pointer file names the folders that readers see.

    A table is written beside the old one and made current, with all others of its generation, by one rename, so a reader
    or a crash never sees half of it. Tables that are not given stay where they are; nothing is copied. Folders that are
    replaced are removed when the next generation is published.
    """

    def __init__(self, root: str):
        self.root, self.files = root, Files(root)
        self.files.make()

    def manifest(self) -> dict | None:
        found = self.files.text("CURRENT")
        return None if found is None else json.loads(found)

    def exists(self) -> bool:
        return self.manifest() is not None

    def generation(self) -> int:
        return (self.manifest() or {"generation": 0})["generation"]

    def paths(self, name: str) -> list[str]:
        return [f"{self.files.root}/{p}" for p in self.manifest()["tables"][name]]

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.option("basePath", self.files.root).option("mergeSchema", "true").parquet(*self.paths(name)) if len(self.paths(name)) > 1 else spark.read.parquet(*self.paths(name))

    def has(self, name: str) -> bool:
        found = self.manifest()
        return found is not None and name in found["tables"]

    def publish(self, tables: dict[str, DataFrame], meta: dict | None = None, append: dict[str, DataFrame] | None = None, by: dict[str, tuple] | None = None) -> int:
        """Write ``tables`` and, beside what is there, the rows to ``append``, and switch to them as the next generation.

        ``by`` names, per table, a column by whose values it is laid out in folders, and one by which it is sorted.
        """
        old = self.manifest() or {"generation": 0, "meta": {}, "tables": {}, "replaced": []}
        new = old["generation"] + 1
        current, replaced = dict(old["tables"]), []
        for name, df in (append or {}).items():
            parts = current.get(name, [])
            if len(parts) < MAX_PARTS:
                current[name] = [*parts, self._write(name, new, df.coalesce(1))]
            else:
                tables = tables | {name: self.read(df.sparkSession, name).unionByName(df)}
        for name, df in tables.items():
            replaced += current.get(name, [])
            current[name] = [self._write(name, new, df, (by or {}).get(name))]
        self._switch({"generation": new, "schema_version": SCHEMA_VERSION, "tables": current, "meta": old["meta"] | (meta or {}), "replaced": replaced})
        for path in old.get("replaced", []):
            self.files.remove(path)
        return new

    def _write(self, name: str, generation: int, df: DataFrame, by: tuple | None = None) -> str:
        path = f"{name}/g{generation:06d}-{uuid.uuid4().hex[:8]}"
        if by:
            laid_out(df, by).write.partitionBy(by[0]).parquet(f"{self.files.root}/{path}")
        else:
            df.write.parquet(f"{self.files.root}/{path}")
        return path

    def _switch(self, manifest: dict) -> None:
        temp = f"CURRENT.{uuid.uuid4().hex[:8]}"
        self.files.write(temp, json.dumps(manifest))
        self.files.replace(temp, "CURRENT")

    def meta(self, key: str, default=None):
        return (self.manifest() or {"meta": {}})["meta"].get(key, default)

    def set_meta(self, **values) -> None:
        found = self.manifest() or {"generation": 0, "schema_version": SCHEMA_VERSION, "tables": {}, "meta": {}, "replaced": []}
        found["meta"] |= values
        self._switch(found)

    def current_schema(self) -> bool:
        return (self.manifest() or {}).get("schema_version") == SCHEMA_VERSION

    @contextmanager
    def lock(self, name: str = "sync"):
        """Hold a writer lock or raise LockHeld; a lock of a process of this host that is gone, or a very old one, is taken over."""
        path, mine = f"{name}.lock", json.dumps({"host": socket.gethostname(), "pid": os.getpid(), "at": time.time()})
        try:
            self.files.write(path, mine)
        except Exception:
            held = self.files.text(path)
            if held and not _left_behind(held):
                raise LockHeld(f"{name} is held: {held}") from None
            # only one of several takers finds the old lock to move away
            if held and not self.files.move(path, f"{path}.{uuid.uuid4().hex}"):
                raise LockHeld(f"{name} was just taken over") from None
            try:
                self.files.write(path, mine)
            except Exception:
                raise LockHeld(f"{name} was just taken") from None
        try:
            yield
        finally:
            self.files.remove(path)


def _left_behind(lock: str) -> bool:
    try:
        held = json.loads(lock)
        if held["host"] != socket.gethostname():
            return time.time() - held["at"] > LOCK_AGE
        os.kill(held["pid"], 0)
        return False
    except ProcessLookupError:
        return True
    except (ValueError, KeyError, TypeError):
        return True
    except PermissionError:
        return False


def log_error(root: str, context: str, message: str, most: int = 500) -> None:
    """Keep an error as a small file of its own; of more than ``most``, the older half goes."""
    files = Files(root)
    line = f"{time.strftime('%Y-%m-%dT%H:%M:%SZ', time.gmtime())} [{context}] {message[:2000]}"
    files.write(f"errors/{time.time_ns():020d}-{uuid.uuid4().hex[:6]}", line)
    names = files.names("errors")
    for name in names[: len(names) // 2] if len(names) > most else []:
        files.remove(f"errors/{name}")


def recent_errors(root: str, lines: int = 20) -> list[str]:
    files = Files(root)
    return [files.text(f"errors/{name}") for name in files.names("errors")[-lines:]]
