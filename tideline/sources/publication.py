"""Tables and releases that change by one atomic step.

Data is written aside first and never changed. What a table consists of is a log
of small numbered files, and a change takes effect when its file is renamed into
the log under the next number; the rename fails if another writer has taken that
number, who then has to be looked at first. A writer that dies before leaves data
that nothing names. Readers see one number's state.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer has changed the table since it was read."""


class DuplicateRows(ValueError):
    """Rows that an append-only table already holds."""


class Log:
    """Numbered events of a folder, each a small JSON file."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, *parts: str) -> JavaObject:
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def files(self) -> JavaObject:
        return self.path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def rename(self, old: JavaObject, new: JavaObject) -> None:
        """Move within the folder in one step; Conflict if ``new`` exists."""
        jvm, fs = self.spark._jvm, self.files()
        fs.mkdirs(new.getParent())
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(old).toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(old, new, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception.toString()):
                raise Conflict(f"[PATH_ALREADY_EXISTS] {new}") from e
            raise

    def numbers(self) -> list[int]:
        return sorted(int(x.getPath().getName().split(".")[0]) for x in self.files().globStatus(self.path("_log", "*.json")) or [])

    def number(self) -> int:
        """The number of the last event, 0 before the first."""
        return max(self.numbers(), default=0)

    def events(self, number: int | None = None) -> list[dict[str, Any]]:
        """All events up to a number, in order. There is one for each change of the table, so they are few beside its rows."""
        found = [n for n in self.numbers() if number is None or n <= number]
        if not found:
            return []
        lines = self.spark.read.text([f"{self.root}/_log/{n:08d}.json" for n in found]).collect()
        return sorted((json.loads(r.value) for r in lines), key=lambda e: e["number"])

    def commit(self, number: int, event: dict[str, Any]) -> None:
        """Make ``event`` the one of this number; Conflict if there is one."""
        aside = self.path("_aside", f"{uuid.uuid4().hex}.json")
        out = self.files().create(aside)
        out.write(bytearray(json.dumps({"number": number} | event).encode()))
        out.close()
        try:
            self.rename(aside, self.path("_log", f"{number:08d}.json"))
        except Conflict:
            self.files().delete(aside, False)
            raise


class Table:
    """Rows that grow by appends and merges; writers that meet repeat their check on the newer state."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType):
        self.log, self.spark, self.schema = Log(spark, root), spark, schema

    def read(self, number: int | None = None) -> DataFrame:
        """The rows after an event, the last one by default."""
        parts: list[str] = []
        for e in self.log.events(number):
            parts = [e["part"]] if e["op"] == "replace" else [*parts, e["part"]]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.log.root}/{p}" for p in parts))

    def change(self, made: Callable[[DataFrame], DataFrame], op: str = "add", tries: int = 20) -> int:
        """Commit the rows that ``made`` makes of the present ones; made anew if another writer comes first. The number that it got."""
        for _ in range(tries):
            number, part = self.log.number(), f"part-{uuid.uuid4().hex}"
            made(self.read(number)).select(*self.schema.names).write.parquet(f"{self.log.root}/{part}")
            try:
                self.log.commit(number + 1, {"op": op, "part": part})
            except Conflict:
                self.log.files().delete(self.log.path(part), True)
                continue
            return number + 1
        raise Conflict(f"{tries} writers came first")

    def append_new(self, rows: DataFrame, key: str = "id") -> int:
        """Append rows whose key the table does not hold; of rows with one key, one."""
        first = rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(key))).where("_k = 1").drop("_k")
        return self.change(lambda old: first.join(old.select(key), key, "left_anti"))

    def append_once(self, rows: DataFrame, key: str = "id") -> int:
        """Append rows; DuplicateRows if a key occurs twice or is there already, and nothing is written."""

        def checked(old: DataFrame) -> DataFrame:
            twice = rows.select(key).union(old.select(key).join(rows.select(key), key, "left_semi")).groupBy(key).count().where("count > 1")
            if twice.limit(1).count():
                raise DuplicateRows(key)
            return rows

        return self.change(checked)

    def merge(self, rows: DataFrame, key: str, order: Column) -> int:
        """Rows replace those of their key; of several with one key the last by ``order`` stays."""
        rest = [c for c in self.schema.names if c != key]
        last = rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, *(F.col(f"r.{c}").alias(c) for c in rest))
        return self.change(lambda old: old.join(last.select(key), key, "left_anti").select(*self.schema.names).unionByName(last), "replace")


def folder_digest(spark: SparkSession, path: str) -> tuple[str, int]:
    """SHA-256 over the SHA-256s of a folder's data files, in their order, and their bytes. Files are hashed where they are read, 2 GB each at most."""
    hashed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select(F.sha2("content", 256).alias("h"), "length")
    r = hashed.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("d"), F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()
    return r.d, r.n


class Releases:
    """Named, immutable versions of a table, of which one is current and one the champion."""

    def __init__(self, spark: SparkSession, root: str):
        self.log, self.spark = Log(spark, root), spark

    def publish(self, rows: DataFrame, name: str, about: dict[str, Any] | None = None) -> dict[str, Any]:
        """Write a version aside, hash its bytes, rename it into place, and make it current last.

        Conflict if the name is taken; ``about`` (provenance, metrics) is kept with it.
        """
        aside = f"_aside/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.log.root}/{aside}")
        digest, size = folder_digest(self.spark, f"{self.log.root}/{aside}")
        count = self.spark.read.parquet(f"{self.log.root}/{aside}").count()
        self.log.rename(self.log.path(aside), self.log.path("versions", name))
        event = {"op": "publish", "name": name, "sha256": digest, "bytes": size, "rows": count, "about": about or {}}
        self._committed(event)
        return event

    def _committed(self, event: dict[str, Any]) -> None:
        while True:
            try:
                return self.log.commit(self.log.number() + 1, event)
            except Conflict:
                continue  # an event of another writer: both hold, in either order

    def state(self) -> dict[str, Any]:
        """``versions`` by name in the order of publication, ``current`` and ``champion``."""
        versions: dict[str, dict[str, Any]] = {}
        champion = None
        for e in self.log.events():
            if e["op"] == "publish":
                versions[e["name"]] = e
            elif e["op"] == "drop":
                versions.pop(e["name"], None)
            elif e["op"] == "promote":
                champion = e["name"]
        return {"versions": versions, "current": next(reversed(versions), None), "champion": champion}

    def promote(self, name: str) -> None:
        """Make a version the champion."""
        if name not in self.state()["versions"]:
            raise KeyError(name)
        self._committed({"op": "promote", "name": name})

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.log.root}/versions/{name}")

    def current(self) -> DataFrame:
        return self.read(self.state()["current"])

    def intact(self, name: str) -> bool:
        """Whether the bytes of a version are those that were published."""
        told = self.state()["versions"][name]
        return folder_digest(self.spark, f"{self.log.root}/versions/{name}") == (told["sha256"], told["bytes"])

    def retain(self, keep: int) -> list[str]:
        """Drop all versions but the newest ``keep`` and the champion, from the log first and then from disk; their names."""
        state = self.state()
        names = list(state["versions"])
        gone = [n for n in names[: max(0, len(names) - max(1, keep))] if n != state["champion"]]
        for name in gone:
            self._committed({"op": "drop", "name": name})
            self.log.files().delete(self.log.path("versions", name), True)
        return gone

    def sweep(self) -> None:
        """Delete what writers that died have left: data aside, and version folders that no event names. Only when no writer is at work."""
        self.log.files().delete(self.log.path("_aside"), True)
        known = self.state()["versions"]
        for found in self.log.files().globStatus(self.log.path("versions", "*")) or []:
            if found.getPath().getName() not in known:
                self.log.files().delete(found.getPath(), True)
