"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where it is missing and all of Spark runs in this process, as in tests, a folder
    of this machine is set; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = current.get() if current.isDefined() else None
    if not found:
        if not spark.sparkContext._jsc.sc().isLocal():
            raise RuntimeError("spark.checkpoint.dir names no folder that executors share")
        found = tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discarded(df: DataFrame) -> None:
    """Deletes the files of a table that ``stored`` gave and nothing reads any more."""
    where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Pointer:
    """A small JSON document below a path that is only ever replaced as a whole."""

    def __init__(self, spark: SparkSession, path: str, name: str = "current.json"):
        self.spark, self.path, self.name = spark, path, name

    def _at(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def exists(self, name: str) -> bool:
        fs, where = self._at(name)
        return fs.exists(where)

    def read(self) -> dict:
        """What was written last; empty if that is nothing or can't be read."""
        if not self.exists(self.name):
            return {}
        try:
            said = json.loads("\n".join(r["value"] for r in self.spark.read.text(f"{self.path}/{self.name}").collect()))
        except ValueError:
            return {}
        return said if isinstance(said, dict) else {}

    def write(self, said: dict) -> None:
        """Writes another file and renames it over the old one in one step, so that a reader sees the one or the other, and a crash leaves the old one."""
        fs, made = self._at(f".{self.name}.{uuid.uuid4().hex}")
        out = fs.create(made, False)
        out.write(bytearray(json.dumps(said), "utf-8"))
        out.close()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        how = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(made).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(fs.makeQualified(made), fs.makeQualified(self._at(self.name)[1]), how)

    def delete(self, name: str) -> None:
        fs, where = self._at(name)
        fs.delete(where, True)

    def names(self) -> list[str]:
        fs, where = self._at("")
        return [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []


class Snapshots:
    """Versions of a state table below one path, with a pointer to the current one.

    A save writes a new version and then moves the pointer, so that a reader never
    sees half a table and a lazy plan over the former version stays valid. A table
    that is missing, of another format version, or unreadable counts as empty.

    A save can be the commit of a stream's batch. The pointer then names the batch
    with the table, and a batch that was committed before is left alone, so that one
    that is tried again after a crash changes the table once.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, version: int = 1):
        self.spark, self.path, self.schema, self.version = spark, path, schema, version
        self.pointer = Pointer(spark, path)

    def _said(self) -> dict:
        said = self.pointer.read()
        return said if said.get("version") == self.version else {}

    def load(self) -> DataFrame:
        name = self._said().get("table")
        if name is None or not self.pointer.exists(name):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{name}")

    def committed(self, stream: str) -> int:
        """The last batch of a stream that was committed, or -1."""
        return self._said().get("batches", {}).get(stream, -1)

    def save(self, df: DataFrame, stream: str | None = None, batch: int = 0) -> bool:
        """Whether the table was saved; it isn't where the stream's batch has been committed."""
        said = self._said()
        batches = said.get("batches", {})
        if stream is not None and batch <= batches.get(stream, -1):
            return False
        name = f"table-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        self.pointer.write({"version": self.version, "table": name, "former": said.get("table"), "batches": batches | ({} if stream is None else {stream: batch})})
        return True

    def once(self, stream: str, batch: int, step: str, action: Callable[[], None]) -> bool:
        """Runs a step of a batch unless a mark says that it has been run; the mark is made after it, so a crash between the two runs it again."""
        mark = Pointer(self.spark, f"{self.path}/steps", f"{stream}-{batch:012d}-{step}.json")
        if mark.read():
            return False
        action()
        mark.write({"batch": batch})
        return True

    def vacuum(self) -> None:
        """Deletes tables that are neither the current nor the former one, such as those of tries that failed, and marks of committed batches. Not while a save runs."""
        said = self._said()
        for name in self.pointer.names():
            if name.startswith("table-") and name not in (said.get("table"), said.get("former")):
                self.pointer.delete(name)
        for name in Pointer(self.spark, f"{self.path}/steps").names():
            stream, _, rest = name.rpartition(".json")[0].rpartition("-")[0].rpartition("-")
            if stream and rest.isdigit() and int(rest) <= said.get("batches", {}).get(stream, -1):
                self.pointer.delete(f"steps/{name}")


# The kept tables of a repository: what was found and fingerprinted, what failed last, what was overlaid.
STATE = {
    "discovered": "project string, classes array<string>",
    "digest": "file string, fp string",
    "stamps": "project string, n long, newest_ms long, digest string",
    "last_failures": "class_fqn string",
    "overlay": "file string",
    "diagnostics": "project string, item string",
    "bindings": "from_key string, to string, source string, confirms long, contradicts long, last_seq long, evidence array<string>",
}


def state(spark: SparkSession, path: str, name: str, version: int = 1) -> Snapshots:
    """One of the kept tables below ``path``."""
    return Snapshots(spark, f"{path}/{name}", StructType.fromDDL(STATE[name]), version)
