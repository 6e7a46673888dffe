"""How far the sources of a language differ in their terms, and in which.

Every group (a language and a source) is a vector over the language's terms. The
vectors are cut into slices of terms, and the groups of a language into seats of a
few. In a task the seat's groups stay in place, slice by slice, while the vectors
of the others come by in the order of a round-robin tournament: any two seats meet
once, at one of them, and both directions of a pair are taken at that meeting. A
visitor is held for as long as it is met. The language's own vector comes to each
seat first; against it, each group keeps the terms in which it stands out most in
a heap. Slices are dealt to strips, so that a language with few sources keeps many
tasks busy; sums and heaps of the strips are put together at the end.

A vector travels as the compressed places and counts of the terms that occur; a
probability is floored at a billionth and all arithmetic is on whole numbers.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

#: Terms of a slice on average, groups of a seat, and strips of a language.
TERMS, SEAT, STRIPS = 2048, 16, 64
#: Groups of terms that a task sums up before it passes them on.
HELD = 200_000
#: Capital letters become small ones; what else is not above U+007F and no letter becomes a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and characters above U+007F, A-Z lower-cased, in UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    most = 0  # what is held cannot be more

    def told() -> Iterator[pa.RecordBatch]:
        for (lang, source), (count, docs) in held.items():
            terms = list(count)
            for k in range(0, len(terms), 10_000):
                part = terms[k : k + 10_000]
                columns = [pa.array([v] * len(part), pa.string()) for v in (lang, source)]
                columns.append(pa.array(part, pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays([*columns, pa.array([count[t] for t in part], pa.int64()), pa.array([docs[t] for t in part], pa.int64())], ["lang", "source", "term", "count", "docs"])
        held.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            count, docs = held.setdefault((lang, source), (Counter(), Counter()))
            own = Counter(terms_of(text))
            count.update(own)
            docs.update(own.keys())
            if (most := most + len(own)) > HELD and (most := sum(len(c) for c, _ in held.values())) > HELD:
                yield from told()
                most = 0
    yield from told()


def shares(counts: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(1e9 * (count + 1) / total), exactly, for totals under 9e15: a long division by thousands."""
    out, rest = np.zeros(len(counts), np.int64), counts + 1
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return out + 1


def packed(places: np.ndarray, counts: np.ndarray) -> bytes:
    return zlib.compress(np.concatenate((np.diff(places, prepend=0), counts)).astype(np.int64).tobytes(), 1)


def unpacked(vector: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    if vector is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.frombuffer(zlib.decompress(vector), np.int64)
    return np.cumsum(both[: len(both) // 2]), both[len(both) // 2 :]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = [packed(np.array(p, np.int64), np.array(c, np.int64)) for p, c in zip(batch.column("places").to_pylist(), batch.column("counts").to_pylist(), strict=True)]
        names = [zlib.compress(" ".join(t).encode(), 1) if whole else None for t, whole in zip(batch.column("terms").to_pylist(), batch.column("whole").to_pylist(), strict=True)]
        keys = ["lang", "slice", "source", "whole"]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(vectors, pa.binary()), pa.array(names, pa.binary())], [*keys, "vector", "names"])


def _dense(vector: bytes | None, total: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    places, counts = unpacked(vector)
    total = max(total, 1)
    out = np.full(max(width, int(places[-1]) + 1 if len(places) else 0), shares(np.zeros(1, np.int64), total)[0])
    out[places] = shares(counts, total)
    return out, places


class _Seat:
    """The groups of one seat, in one strip: who is there in this slice, sums by pair, and a heap for each group."""

    def __init__(self, top: int):
        self.top, self.slice = top, None
        self.sums: dict[tuple[str, str], int] = {}
        self.best: dict[str, list[tuple[int, bytes]]] = {}

    def _widen(self, width: int) -> None:
        if (more := width - self.here.shape[1]) > 0:
            self.here = np.hstack([self.here, np.repeat(self.rest[:, None], more, axis=1)])

    def _meet(self, name: str, own: np.ndarray, alone: int) -> None:
        """Both directions between a vector and all groups that are here, over what is not the same for terms that neither has."""
        self._widen(len(own))
        own = np.concatenate((own, np.full(self.here.shape[1] - len(own), alone)))
        square = (self.here - own) ** 2
        base = (self.rest - alone) ** 2
        towards = (square // own - (base // alone)[:, None]).sum(axis=1)
        back = (square // self.here - (base // self.rest)[:, None]).sum(axis=1)
        for other, a, b in zip(self.names, towards.tolist(), back.tolist(), strict=True):
            self.sums[other, name] = self.sums.get((other, name), 0) + a
            self.sums[name, other] = self.sums.get((name, other), 0) + b

    def take(self, row: dict) -> None:
        if row["slice"] != self.slice:
            self.slice, self.names, self.here, self.rest = row["slice"], [], np.zeros((0, 0), np.int64), np.zeros(0, np.int64)
        if row["round"] == -2:  # the language's own vector
            self.whole, _ = _dense(row["vector"], row["total"], 0)
            self.terms = np.array(zlib.decompress(row["names"]).split(b" "), object) if row["names"] is not None else np.zeros(0, object)
            return
        own, places = _dense(row["vector"], row["total"], 0)
        alone = int(shares(np.zeros(1, np.int64), max(row["total"], 1))[0])
        if self.names:
            self._meet(row["source"], own, alone)
        if row["round"] == -1:  # it stays
            self.names.append(row["source"])
            self._widen(len(own))
            self.here = np.vstack([self.here, np.concatenate((own, np.full(self.here.shape[1] - len(own), alone)))[None, :]])
            self.rest = np.append(self.rest, alone)
            p, q = own[places], self.whole[places]
            places, value = places[p > q], ((p - q) ** 2 // q)[p > q]
            heap = self.best.setdefault(row["source"], [])
            if len(heap) == self.top:
                worst = -heap[-1][0]
                places, value = places[value >= worst], value[value >= worst]
            self.best[row["source"]] = heapq.nsmallest(self.top, [*heap, *zip((-value).tolist(), self.terms[places], strict=True)])

    def told(self, lang: str) -> pa.RecordBatch:
        pairs = [(a, "pair", b, v) for (a, b), v in self.sums.items()]
        terms = [(a, "term", t.decode(), -v) for a, heap in self.best.items() for v, t in heap]
        rows = pairs + terms
        columns = [pa.array([lang] * len(rows), pa.string()), *(pa.array([r[k] for r in rows], pa.string()) for k in range(3)), pa.array([r[3] for r in rows], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["lang", "source", "part", "item", "value"])


def _rotate(batches: Iterator[pa.RecordBatch], top: int) -> Iterator[pa.RecordBatch]:
    key, seat = None, None
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
            if (row["lang"], row["strip"], row["host"]) != key:
                if seat:
                    yield seat.told(key[0])
                key, seat = (row["lang"], row["strip"], row["host"]), _Seat(top)
            seat.take(row)
    if seat:
        yield seat.told(key[0])


def meetings(seat: str, seats: str) -> Column:
    """(round, host) of the meetings to which ``seat`` travels, of ``seats`` in its language.

    The circle method: the last place stays, the others turn by one each round. Of
    two that meet, one is the host, by turns; an odd number leaves one place empty,
    and who would meet it rests.
    """
    ring = f"({seats} + {seats} % 2 - 1)"
    turn, rounds = f"pmod({seat} - r, {ring})", f"sequence(cast(0 as long), {ring} - 1)"
    last = f"CASE WHEN r % 2 = 0 THEN {ring} END"  # the turning one travels to the last place in even rounds
    host = f"""CASE WHEN {seat} = {ring} THEN CASE WHEN r % 2 = 1 THEN r END
      WHEN {turn} = 0 THEN {last}
      WHEN 2 * {turn} > {ring} THEN pmod(r - {turn}, {ring}) END"""
    met = f"filter(transform({rounds}, r -> named_struct('round', cast(r as int), 'host', cast({host} as long))), m -> m.host IS NOT NULL AND m.host < {seats})"
    return F.expr(f"CASE WHEN {seats} > 1 THEN {met} ELSE cast(array() as array<struct<round:int,host:long>>) END")


def audit(docs: DataFrame, least_docs: int = 3, top: int = 200, slice_terms: int = TERMS, seat_groups: int = SEAT) -> DataFrame:
    """(lang, source, part, item, value, rank) for every group of ``docs`` (text, lang, source).

    Terms are kept that occur in ``least_docs`` documents of the language or more.
    With p = 1 + floor(1e9 * (count + 1) / (N + V)) for each kept term, N the
    group's count of all kept terms and V their number in the language, part
    ``pair`` has floor((p - q) ** 2 / q) summed over the kept terms for each other
    source of the language, q that source's p; part ``term`` has it for the terms
    that the group has and whose p is over the language's q, down to rank ``top``.
    Ranks are by value, largest first, then by the item's bytes. Null texts,
    languages and sources are empty strings; a language with one source has no
    pairs; without kept terms the pairs have value 0; groups without terms take
    part. No documents give no rows. Every row is a document, whatever it has for
    an id; other columns are not read.

    Bounds: a task holds the vectors of one seat over one slice, a visitor, the sums
    of its seat with all sources, and its heaps.
    """
    text, lang, source = (F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source"))
    docs = docs.select(text, lang, source)
    partial_counts = docs.mapInArrow(_count, "lang string, source string, term string, count long, docs long")
    counts = partial_counts.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    counts = counts.withColumns({"in_lang": F.sum("docs").over(of_term), "lang_count": F.sum("count").over(of_term)})
    # one row of a term stands for it
    kept = counts.where(F.col("in_lang") >= least_docs).withColumn("first", F.col("source") == F.min("source").over(of_term))
    kept = written(kept.select("lang", "source", "term", "count", "lang_count", "first"), "kept-terms")

    langs = kept.groupBy("lang").agg(F.sum(F.col("first").cast("long")).alias("v"))
    totals = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    own = Window.partitionBy("lang")
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    slices = F.expr(f"greatest(1, (v + {slice_terms - 1}) div {slice_terms})").alias("slices")
    groups = groups.select("lang", "source", "v", F.col("n") + F.col("v"), slices, F.sum("n").over(own) + F.col("v"), F.row_number().over(own.orderBy("source")) - 1, F.count("*").over(own))
    groups = groups.toDF("lang", "source", "v", "total", "slices", "lang_total", "number", "size").withColumns({"seat": F.expr(f"number div {seat_groups}"), "seats": F.expr(f"(size + {seat_groups - 1}) div {seat_groups}")})
    groups = written(groups, "groups")

    numbered = kept.join(groups.select("lang", "slices").distinct(), "lang").withColumn("slice", F.expr("pmod(xxhash64(term), slices)"))
    numbered = numbered.withColumn("place", F.dense_rank().over(Window.partitionBy("lang", "slice").orderBy("term")) - 1)
    # the language's own vector has each term once, with its name
    own_entry, lang_entry = "named_struct('source', source, 'whole', false, 'count', count, 'term', cast(null as string))", "named_struct('source', '', 'whole', true, 'count', lang_count, 'term', term)"
    numbered = numbered.select("lang", "slice", "place", F.explode(F.expr(f"if(first, array({own_entry}, {lang_entry}), array({own_entry}))")).alias("e")).select("lang", "slice", "place", "e.*")
    entries = F.array_sort(F.collect_list(F.struct("place", F.col("count").alias("count"), "term"))).alias("e")
    lists = numbered.groupBy("lang", "slice", "source", "whole").agg(entries)
    lists = lists.select("lang", "slice", "source", "whole", F.col("e.place").alias("places"), F.col("e.count").alias("counts"), F.col("e.term").alias("terms"))
    vectors = written(lists.mapInArrow(_pack, "lang string, slice long, source string, whole boolean, vector binary, names binary"), "vectors")

    # every group has a place in every slice, with a vector or without
    grid = groups.withColumn("slice", F.explode(F.expr("sequence(cast(0 as long), slices - 1)")))
    seated = grid.join(vectors.where("NOT whole"), ["lang", "slice", "source"], "left").select("lang", "slice", "source", "total", "seat", "seats", "vector")
    at_home = F.expr("array(named_struct('round', -1, 'host', seat))")
    going = seated.withColumn("m", F.explode(F.concat(at_home, meetings("seat", "seats")))).select("lang", "slice", "source", "total", "vector", "m.host", "m.round")
    seats = groups.select("lang", "slices", F.col("lang_total").alias("total"), F.col("seat").alias("host")).distinct()
    whole = seats.withColumn("slice", F.explode(F.expr("sequence(cast(0 as long), slices - 1)"))).join(vectors.where("whole").drop("source"), ["lang", "slice"], "left")
    whole = whole.select("lang", "slice", F.lit("").alias("source"), "total", "vector", "host", F.lit(-2).alias("round"), "names")
    rows = going.withColumn("names", F.lit(None).cast("binary")).unionByName(whole)
    rows = rows.withColumn("strip", F.col("slice") % STRIPS).repartition("lang", "strip", "host").sortWithinPartitions("lang", "strip", "host", "slice", "round", "source")
    parts = rows.mapInArrow(partial(_rotate, top=top), "lang string, source string, part string, item string, value long")

    sums = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    # what terms that neither group has add to a pair
    of = lambda total: F.lit(1) + F.expr(f"1000000000 div greatest({total}, 1)")
    a = groups.select("lang", "source", "v", of("total").alias("p"))
    b = groups.select("lang", F.col("source").alias("item"), of("total").alias("q"))
    pairs = sums.where("part = 'pair'").join(a, ["lang", "source"]).join(b, ["lang", "item"])
    pairs = pairs.select("lang", "source", "part", "item", (F.col("value") + F.col("v") * F.expr("((p - q) * (p - q)) div q")).alias("value"))
    ranked = pairs.unionByName(sums.where("part = 'term'").select("lang", "source", "part", "item", "value"))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT k, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS c FROM t GROUP BY 1, 2 HAVING count(DISTINCT k) >= 3),
v AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY 1),
c AS (SELECT t.lang, source, t.term, count(*) AS c FROM t JOIN kept ON kept.lang = t.lang AND kept.term = t.term GROUP BY 1, 2, 3),
n AS (SELECT g.lang, g.source, coalesce(sum(c), 0) AS n FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY 1, 2),
p AS (SELECT n.lang, n.source, kept.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1)) // (n.n + v.v)::HUGEINT AS p
  FROM n JOIN kept ON kept.lang = n.lang JOIN v ON v.lang = n.lang LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = kept.term),
q AS (SELECT kept.lang, term, 1 + (1000000000::HUGEINT * (c + 1)) // (n + v)::HUGEINT AS q FROM kept JOIN v ON v.lang = kept.lang),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3) s ON s.lang = a.lang AND s.source = a.source AND s.other = b.source),
term AS (SELECT p.lang, source, 'term' AS part, p.term AS item, ((p - q) * (p - q)) // q AS value FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE c > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""
