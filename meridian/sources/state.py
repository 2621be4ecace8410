"""State on shared storage: frames that outlive lost executors, and named tables with a pointer to the current one."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir (where that is unset, as in tests, under a temporary one). Hadoop removes what lies there when the application ends."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            base = "file://" + tempfile.mkdtemp(prefix="meridian-")
            spark.conf.set("spark.checkpoint.dir", base)
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/meridian-{uuid.uuid4().hex}")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        path = fs.makeQualified(path)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _folders[app] = path.toString()
    return f"{_folders[app]}/{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and read back from the cluster's shared folder: lineage ends there, and the planner knows its true size.

    (Dataset.checkpoint computes twice and keeps estimates, which multiply from join to join over the rounds of a loop.)
    """
    at = shared_folder(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


class StateStore:
    """Versions of named tables in one folder. Version n is the file `commits/n`, which says where each table lies; the greatest n is current.

    That file is made by exclusive create, so of several writers that replace one version exactly one wins, and readers see all
    tables of a version or none. The file system must be one where a create without overwrite fails if the file is there (HDFS,
    local disks, object stores with conditional writes). Data is written before, under a name of its own; what a loser wrote is
    removed again.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        path = spark._jvm.org.apache.hadoop.fs.Path(folder.rstrip("/"))
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.folder = self.fs.makeQualified(path).toString()

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))

    def versions(self) -> list[str]:
        """The committed versions, oldest first."""
        if not self.fs.exists(self._path("commits")):
            return []
        return sorted(f.getPath().getName() for f in self.fs.listStatus(self._path("commits")) if f.getPath().getName().isdigit())

    def current(self) -> str | None:
        """The committed version, or None before the first commit."""
        return max(self.versions(), default=None)

    def _manifest(self, version: str) -> dict[str, str]:
        path = self._path("commits", version)
        data = self.fs.open(path)
        try:
            size = self.fs.getFileStatus(path).getLen()
            return json.loads(bytes(data.readNBytes(int(size))).decode())
        finally:
            data.close()

    def tables(self, version: str | None = None) -> dict[str, DataFrame]:
        """All tables of a version (the current one)."""
        version = version or self.current()
        return {n: self.spark.read.parquet(f"{self.folder}/{at}") for n, at in self._manifest(version).items()} if version else {}

    def load(self, name: str, version: str | None = None) -> DataFrame:
        return self.tables(version)[name]

    def _create(self, version: str, manifest: dict[str, str]) -> bool:
        """Make the version's file, unless it is there."""
        path, data = self._path("commits", version), json.dumps(manifest, sort_keys=True).encode()
        jvm = self.spark._jvm
        if self.fs.getScheme() == "file":  # Hadoop's local file system looks first and creates then; this does both at once
            self.fs.mkdirs(path.getParent())
            own = self._path("data", f".{uuid.uuid4().hex}")
            self._write(own, data)
            to = jvm.java.nio.file.Path.of(path.toUri())
            try:
                jvm.java.nio.file.Files.createLink(to, jvm.java.nio.file.Path.of(own.toUri()))
                return True
            except Py4JJavaError as e:
                if "FileAlreadyExists" in e.java_exception.getClass().getName():
                    return False
                raise
            finally:
                self.fs.delete(own, False)
        try:
            out = self.fs.create(path, False)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        out.write(data)
        out.close()
        return True

    def _write(self, path, data: bytes) -> None:
        out = self.fs.create(path, False)
        out.write(data)
        out.close()

    def commit(self, tables: dict[str, DataFrame], expected: str | None, keep: bool = False) -> str:
        """Replace version `expected` by one with these tables, and with `keep` its other tables too; ValueError if another commit came first."""
        if self.current() != expected:
            raise ValueError(f"the state is at {self.current()}, not at {expected}")
        folder = f"data/{uuid.uuid4().hex}"
        manifest = dict(self._manifest(expected)) if keep and expected else {}
        for name, df in tables.items():
            df.write.parquet(f"{self.folder}/{folder}/{name}")
            manifest[name] = f"{folder}/{name}"
        version = f"{int(expected or 0) + 1:012d}"
        if not self._create(version, manifest):
            self.fs.delete(self._path(folder), True)
            raise ValueError(f"the state is at {self.current()}, not at {expected}")
        if self.current() != version:  # what came after `expected` has been forgotten meanwhile
            self.fs.delete(self._path("commits", version), False)
            self.fs.delete(self._path(folder), True)
            raise ValueError(f"the state is at {self.current()}, not at {expected}")
        return version

    def amend(self, change: Callable[[dict[str, DataFrame]], dict[str, DataFrame]], tries: int = 5) -> str:
        """Commit change(current tables), and what it leaves out as it is; after another writer's commit, change what that one made. All in one version or not at all."""
        for left in reversed(range(tries)):
            at = self.current()
            try:
                return self.commit(change(self.tables(at)), at, keep=True)
            except ValueError:
                if not left or self.current() == at:
                    raise
        raise ValueError("no tries are left")

    def forget(self, keep: int = 2) -> None:
        """Remove all but the last `keep` versions, and the data that only those had."""
        old, new = self.versions()[:-keep], self.versions()[-keep:]
        used = {at for v in new for at in self._manifest(v).values()}
        gone = {at for v in old for at in self._manifest(v).values()} - used
        for v in old:
            self.fs.delete(self._path("commits", v), False)
        for at in gone:
            self.fs.delete(self._path(at), True)


def log_sink(df: DataFrame, folder: str) -> None:
    """Append diagnostic rows as JSON lines."""
    df.write.mode("append").json(folder)
