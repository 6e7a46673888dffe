"""Size-tiered compaction of a table kept as immutable shards.

Arrivals are appended as small Parquet shards. Shards of about one size form a
tier; when a tier has enough of them, they are merged into files of the target
size. What the table holds is said by manifests alone: a manifest lists what a
version adds and drops, is written aside and takes effect by one rename that
fails if the version exists, so readers see all of a change or nothing, and a job
that dies leaves only unnamed files. (A store whose rename is not atomic needs
another one for the manifests.) Now and then the state is written as a table, so
that no reader has to go through all manifests.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TARGET, FAN_IN, SMALLEST = 64 << 20, 4, 1 << 20
#: Versions from one written state to the next.
SNAPSHOT = 32
CHANGE = "version long, op string, path string, bytes long"


def free_name(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores added until no column has it; Spark does not tell upper from lower case."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int

    @property
    def name(self) -> str:
        return "/".join(self.path.split("/")[-2:])


class Conflict(Exception):
    """Another writer has committed this version."""


class ShardTable:
    """A table under ``root``; ``target`` is the size files are merged to, ``fan_in`` the shards that make a tier full.

    ``shard_column`` is the name under which ``read`` tells the shard of a row: ``_shard`` if no column has it.
    """

    def __init__(self, spark: SparkSession, root: str, schema: StructType, target: int = TARGET, fan_in: int = FAN_IN):
        self.spark, self.root, self.schema, self.target, self.fan_in = spark, root.rstrip("/"), schema, target, fan_in
        self.shard_column = free_name("_shard", schema.names)

    def _path(self, *parts: str) -> JavaObject:
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self) -> JavaObject:
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _found(self, *parts: str) -> list[JavaObject]:
        return list(self._fs().globStatus(self._path(*parts)) or [])

    def _listed(self, folder: str) -> list[Shard]:
        return [Shard(x.getPath().toString(), x.getLen()) for x in self._found(folder, "*.parquet")]

    def version(self) -> int:
        """The last committed version, 0 for a table without any."""
        return max((int(x.getPath().getName().split(".")[0]) for x in self._found("manifests", "*.json")), default=0)

    def state(self, version: int | None = None) -> DataFrame:
        """(path, bytes) of the shards of a version: the last written state up to it, and the changes since."""
        version = self.version() if version is None else version
        written = [int(x.getPath().getParent().getName()) for x in self._found("states", "*", "_SUCCESS")]
        base = max((v for v in written if v <= version), default=0)
        files = [f"{self.root}/manifests/{v:08d}.json" for v in range(base + 1, version + 1)]
        changes = self.spark.read.schema(CHANGE).json(files) if files else self.spark.createDataFrame([], CHANGE)
        added = changes.where("op = 'add'").select("path", "bytes")
        if base:
            added = self.spark.read.schema("path string, bytes long").parquet(f"{self.root}/states/{base}").union(added)
        return added.join(changes.where("op = 'drop'").select("path"), "path", "left_anti")

    def shards(self, version: int | None = None) -> list[Shard]:
        """All shards of a version; Spark lists as many files for any table it reads."""
        return [Shard(r.path, r.bytes) for r in self.state(version).orderBy("path").collect()]

    def small(self) -> list[Shard]:
        """The shards that compaction looks at. Tiers that are full are merged, so there are never many."""
        return [Shard(r.path, r.bytes) for r in self.state().where(F.col("bytes") < self.target // 2).orderBy("path").collect()]

    def commit(self, version: int, add: list[Shard], drop: list[Shard]) -> None:
        """Make these changes version ``version`` of the table; Conflict if that exists."""
        jvm, fs = self.spark._jvm, self._fs()
        aside, final = self._path("aside", f"{uuid.uuid4().hex}.json"), self._path("manifests", f"{version:08d}.json")
        fs.mkdirs(final.getParent())
        lines = (json.dumps({"version": version, "op": op} | asdict(s)) + "\n" for op, some in (("add", add), ("drop", drop)) for s in some)
        out = fs.create(aside)
        out.write(bytearray("".join(lines).encode()))
        out.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri() if aside.toUri().getScheme() else fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            files.rename(aside, final, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as e:
            fs.delete(aside, False)
            if "FileAlreadyExists" in str(e.java_exception.toString()):
                raise Conflict(f"version {version} exists") from e
            raise
        if version % SNAPSHOT == 0:
            self.state(version).write.mode("ignore").parquet(f"{self.root}/states/{version}")

    def add(self, folders: list[str]) -> None:
        """Commit the shards that have been written to ``folders``, after whatever others commit."""
        new = [s for f in folders for s in self._listed(f)]
        while True:
            try:
                return self.commit(self.version() + 1, new, [])
            except Conflict:
                continue

    def append(self, arrivals: DataFrame) -> None:
        folder = f"data/append-{uuid.uuid4().hex}"
        arrivals.write.parquet(f"{self.root}/{folder}")
        self.add([folder])

    def replace(self, old: list[Shard], rows: DataFrame) -> bool:
        """Write ``rows`` in place of the shards ``old``; given up (False) if another writer has replaced one of these."""
        folder = f"data/merge-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{folder}")
        while True:
            now = self.version()
            paths = [s.path for s in old]
            if self.state(now).where(F.col("path").isin(paths)).count() < len(paths):
                self._fs().delete(self._path(folder), True)
                return False
            try:
                self.commit(now + 1, self._listed(folder), old)
                return True
            except Conflict:
                continue

    def tier(self, shard: Shard) -> int:
        return max(0, math.floor(math.log(max(shard.bytes, 1) / SMALLEST, self.fan_in)) + 1) if shard.bytes > SMALLEST else 0

    def compact(self) -> int:
        """Merge full tiers, the smallest shards first, until none is full; the number of merges.

        A merge reads its shards once and writes about as many bytes, in tasks of
        a target file each; nothing is shuffled. Files of half the target and more
        are left alone.
        """
        merges = 0
        while True:
            tiers: dict[int, list[Shard]] = {}
            for s in self.small():
                tiers.setdefault(self.tier(s), []).append(s)
            full = next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= self.fan_in), None)
            if full is None:
                return merges
            files = max(1, round(sum(s.bytes for s in full) / self.target))
            merges += self.replace(full, self.spark.read.schema(self.schema).parquet(*(s.path for s in full)).coalesce(files))

    def vacuum(self) -> None:
        """Delete data files that the last version does not name. Only when no reader or writer is at an older one."""
        keep = {s.path for s in self.shards()}
        for x in self._found("data", "*", "*.parquet"):
            if x.getPath().toString() not in keep:
                self._fs().delete(x.getPath(), False)

    def read(self) -> DataFrame:
        """All rows, with the shard they lie in (``shard_column``)."""
        paths = [s.path for s in self.shards()]
        if not paths:
            return self.spark.createDataFrame([], self.schema).withColumn(self.shard_column, F.lit(None).cast("string"))
        rows = self.spark.read.schema(self.schema).parquet(*paths)
        return rows.withColumn(self.shard_column, F.substring_index(rows.metadataColumn("_metadata").getField("file_path"), "/", -2))


def arrive(spark: SparkSession, rows: DataFrame, root: str, batch: Column, batches: int, target: int = TARGET, fan_in: int = FAN_IN) -> ShardTable:
    """Write ``rows`` as ``batches`` arrivals (``batch`` numbers them from 0), committing and compacting after each.

    All arrivals are written in one pass over the rows. Null, empty and repeated
    rows are stored as they are, all columns are kept whatever their names, and an
    arrival without rows adds no shards. A null batch is an arrival of its own,
    after the others.
    """
    table = ShardTable(spark, root, rows.schema, target, fan_in)
    name = free_name("arrival", rows.columns)
    rows.withColumn(name, F.coalesce(batch, F.lit(batches))).write.partitionBy(name).parquet(f"{table.root}/data")
    for k in range(batches + 1):
        folder = f"data/{name}={k}"
        if table._listed(folder):
            table.add([folder])
            table.compact()
    table.vacuum()
    return table
