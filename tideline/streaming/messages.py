"""A price feed as a stream: stored messages replayed from an offset, and the quotes in them.

The feed's messages are kept as Parquet rows (offset, payload) with offsets from 0
on. The source hands out ranges of offsets, at most so many in a batch; the stream's
checkpoint holds the next one, so a restart neither loses nor repeats a message.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

NAME = "stored_messages"
#: Offsets that one task reads.
RANGE = 10_000


class Range(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class _Reader(DataSourceStreamReader):
    def __init__(self, path: str, most: int):
        self.path, self.most = path, most

    def _stored(self):
        import pyarrow.dataset as ds

        return ds.dataset(self.path.removeprefix("file:"), format="parquet", exclude_invalid_files=False)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"next": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        """The end of what is stored; Parquet's own counts tell it."""
        return {"next": self._stored().count_rows()}

    def partitions(self, start: dict, end: dict) -> Sequence[Range]:
        return [Range(k, min(k + self.most, end["next"])) for k in range(start["next"], end["next"], self.most)]

    def read(self, partition: Range) -> Iterator[tuple[int, str | None]]:
        import pyarrow.compute as pc

        wanted = (pc.field("offset") >= partition.start) & (pc.field("offset") < partition.stop)
        for batch in self._stored().to_batches(columns=["offset", "payload"], filter=wanted):
            yield from zip(batch["offset"].to_pylist(), batch["payload"].to_pylist(), strict=True)

    def commit(self, end: dict) -> None:
        pass


class StoredMessages(DataSource):
    """``spark.readStream.format("stored_messages").option("path", folder)``: (offset, payload). The folder has to be one that all machines see."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "offset long, payload string"

    def streamReader(self, schema) -> _Reader:  # noqa: N802, ANN001
        return _Reader(self.options["path"], int(self.options.get("range", RANGE)))


def store(messages: DataFrame, path: str, order: Sequence[str | Column], after: int = 0) -> None:
    """Append messages (payload) to the folder, numbered from ``after`` on in ``order``.

    Numbers come from a range sort and the counts of its parts, so no task sees all.
    """
    spark = messages.sparkSession
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = messages.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_row", F.monotonically_increasing_id())
    ranged.select("payload", "_row").write.mode("overwrite").parquet(f"{path}.sorted")
    rows = spark.read.schema("payload string, _row long").parquet(f"{path}.sorted").withColumn("_part", F.shiftright("_row", 33))
    sizes = sorted((r["_part"], r["count"]) for r in rows.groupBy("_part").count().collect())  # one number for each part
    before, at = {}, after
    for part, count in sizes:
        before[part], at = at, at + count
    if before:
        start = F.create_map(*(F.lit(x) for kv in before.items() for x in kv))[F.col("_part")]
        rows.select((start + F.col("_row").bitwiseAND((1 << 33) - 1)).alias("offset"), "payload").write.mode("append").parquet(path)


def replay(spark: SparkSession, path: str) -> DataFrame:
    """The stored messages as a stream."""
    spark.dataSource.register(StoredMessages)
    return spark.readStream.format(NAME).option("path", path).load()


_ROW = "STRUCT<alis: STRING, satis: STRING, dusuk: STRING, yuksek: STRING, kapanis: STRING, tarih: STRING, dir: STRUCT<satis_dir: STRING>>"
#: Codes of the feed that are quoted, and the codes of the pairs with what may stand in for them.
CODES = ("ALTIN", "AYAR22", "CEYREK_YENI", "YARIM_YENI", "TEK_YENI", "ATA_YENI")
PAIRS = {"ONS": ("ONS",), "USDTRY": ("USDTRY", "USD")}


def quotes(messages: DataFrame) -> DataFrame:
    """(offset, kind, code, bid, ask, low, high, previous, clock, direction) of each message's quotes and pairs.

    Numbers may come as text. A quote needs both sides and an ask above 0, a pair
    both sides; unknown lows, highs and closes of quotes are 0. Messages that do not
    parse, and other codes, give nothing.
    """
    data = F.from_json("payload", f"STRUCT<data: MAP<STRING, {_ROW}>>")["data"]
    number = lambda x: F.expr(f"CASE WHEN isnan(try_cast({x} AS DOUBLE)) OR abs(try_cast({x} AS DOUBLE)) = double('infinity') THEN NULL ELSE try_cast({x} AS DOUBLE) END")
    named = [F.struct(F.lit("quote").alias("kind"), F.lit(c).alias("code"), F.col("d")[c].alias("r")) for c in CODES]
    named += [F.struct(F.lit("pair").alias("kind"), F.lit(c).alias("code"), F.coalesce(*(F.col("d")[k] for k in keys)).alias("r")) for c, keys in PAIRS.items()]
    rows = messages.withColumn("d", data).where("d IS NOT NULL").select("offset", F.explode(F.array(*named)).alias("q")).select("offset", "q.kind", "q.code", "q.r.*")
    quoted = F.col("kind") == "quote"
    known = lambda x: F.when(quoted, F.coalesce(number(x), F.lit(0.0)))
    out = rows.select("offset", "kind", "code", number("alis").alias("bid"), number("satis").alias("ask"), known("dusuk").alias("low"), known("yuksek").alias("high"), known("kapanis").alias("previous"), F.when(quoted, F.right(F.coalesce("tarih", F.lit("")), F.lit(8))).alias("clock"), F.when(quoted, F.coalesce("dir.satis_dir", F.lit(""))).alias("direction"))
    return out.where("bid IS NOT NULL AND ask IS NOT NULL AND (kind = 'pair' OR ask > 0)")
