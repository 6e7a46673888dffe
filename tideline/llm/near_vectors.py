"""Near-duplicate vectors through a pivot-permutation index.

A vector is described by its PREFIX nearest of some reference points (pivots), in
their order. A pair that shares SHARED of them is a candidate, and its cosine is
computed. Each pivot has an inverted list of the vectors that name it. Pivots are
ranked, those that few name first; two descriptions that share enough must then
meet in the list of one of the first PREFIX - SHARED + 1 pivots of each, so no
vector is in more lists. A pair is judged in the list of the first pivot that it
shares, so it counts once.

A list that is counted to be long is divided by the second pivot that a pair
shares: a pair of a list shares further pivots, or is no candidate. What is still
long is cut into blocks, and pairs of blocks are dealt out, so a list that a third
of all vectors share is work for many tasks. Tasks send counts and forests of
links, never pairs. Equal vectors are one vector with a weight.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import written

#: Pivots kept as a vector's description, and how many of them a candidate pair shares.
PREFIX, SHARED = 8, 3
#: Pivots: twice the square root of the number of vectors, so that lists grow as slowly; a sample by a hash of the id.
#: The upper limit bounds what is sent to tasks; it is reached at a billion vectors, beyond which lists are divided more.
FEWEST, MOST = 64, 1 << 16
#: Sample vectors by which pivots are ranked (any ranking gives the same candidates).
RANKED = 4096
#: Vectors of a list that are judged together, and of one that is divided by the second shared pivot.
BLOCK, LONG = 256, 2048

_DESCRIBED = "place long, vec long, weight long, ranks array<int>, vector array<double>"


def _nearest(points: np.ndarray, v: np.ndarray, prefix: int) -> np.ndarray:
    """The ``prefix`` nearest points of each row of ``v``."""
    near = points @ v.T / np.maximum(np.linalg.norm(points, axis=1), 1e-300)[:, None]
    return np.argsort(-near, axis=0, kind="stable")[:prefix].T


def ranking(points: np.ndarray, prefix: int) -> np.ndarray:
    """The rank of each pivot: those that few sample vectors name come first."""
    named = np.zeros(len(points), np.int64)
    for k in range(0, min(RANKED, len(points)), 512):
        top = _nearest(points, points[k : min(k + 512, RANKED)], prefix)
        named += np.bincount(top.ravel(), minlength=len(points))
    return np.argsort(np.argsort(named, kind="stable"), kind="stable")


def _described(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, rank: np.ndarray, prefix: int) -> Iterator[pa.RecordBatch]:
    """Each vector with the ranks of its description, in order of rank."""
    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            part = batch.slice(k, 500)
            size = part.column("dim").to_numpy()
            for dim in np.unique(size):
                own = part.filter(pa.array(size == dim))
                v = own.column("vector").flatten().to_numpy().astype(np.float64).reshape(-1, dim)
                points = pivots[:, :dim] if dim <= pivots.shape[1] else np.pad(pivots, ((0, 0), (0, dim - pivots.shape[1])))
                top = np.sort(rank[_nearest(points, v, prefix)], axis=1).astype(np.int32)
                n, p = top.shape
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * p), pa.array(top.ravel()))
                yield pa.RecordBatch.from_arrays([own.column(c) for c in ("place", "vec", "weight")] + [lists, own.column("vector")], ["place", "vec", "weight", "ranks", "vector"])


def _judge(vec: np.ndarray, weight: np.ndarray, side: np.ndarray, ranks: np.ndarray, v: np.ndarray, first: int, second: int, same: bool, shared: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Weighted numbers of links, and for each vector the first one of its component, of one pair of blocks of the list of ``first`` (and ``second``, unless -1)."""
    local, code = np.unique(ranks, return_inverse=True)
    code = code.reshape(ranks.shape)
    hot = np.zeros((len(vec), len(local)), np.float32)
    hot[np.arange(len(vec))[:, None], code] = 1
    # shared pivots that come before: none, or before the second one the first alone
    before = hot[:, : np.searchsorted(local, second if second >= 0 else first)]
    candidate = (hot @ hot.T >= shared) & (before @ before.T == (second >= 0))
    np.fill_diagonal(candidate, False)
    if not same:
        candidate &= side[:, None] != side
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    a, b = np.nonzero(np.triu(candidate))
    linked = np.zeros(candidate.shape, bool)
    for k in range(0, len(a), 20_000):
        i, j = a[k : k + 20_000], b[k : k + 20_000]
        close = np.einsum("ij,ij->i", unit[i], unit[j]) >= cosine
        linked[i[close], j[close]] = linked[j[close], i[close]] = True
    label = np.arange(len(vec))
    while True:
        least = np.minimum(label, np.where(linked, label, len(vec)).min(axis=1, initial=len(vec)))
        least = np.minimum(least, least[least])
        if (least == label).all():
            return linked @ weight, label
        label = least


KEY = ["place", "first", "second", "i", "j"]


def _joined(batches: Iterator[pa.RecordBatch], shared: int, cosine: float) -> Iterator[pa.RecordBatch]:
    """Counts and links of pairs of blocks; rows come sorted by pair."""
    held: list[pa.RecordBatch] = []

    def judged() -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        vec, weight, side = (t[c].to_numpy() for c in ("vec", "weight", "side"))
        grid = lambda c: t[c].combine_chunks().flatten().to_numpy().reshape(len(vec), -1)
        one = lambda c: t[c][0].as_py()
        n, first = _judge(vec, weight, side, grid("ranks"), grid("vector"), one("first"), one("second"), one("i") == one("j"), shared, cosine)
        k = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays([pa.array(vec[k]), pa.array(n[k].astype(np.int64)), pa.array(vec[first[k]])], ["vec", "n", "other"])

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.column_stack([batch.column(c).to_numpy().astype(np.int64) for c in KEY])
        starts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for a, b in zip([0, *starts.tolist()], [*starts.tolist(), len(keys)], strict=True):
            key = tuple(keys[a].tolist())
            if key != last and held:
                if sum(x.num_rows for x in held) > 1:
                    yield judged()
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if sum(x.num_rows for x in held) > 1:
        yield judged()


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.98, prefix: int = PREFIX, shared: int = SHARED) -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    Vectors link when their labels (and lengths) are equal and their cosine, in
    double precision, is at least ``cosine``; what the index misses is not linked,
    and nothing below is. Null labels, null ids, null, empty and zero vectors and
    those with null or non-finite components link with nothing. Equal vectors
    link with each other; every repeated row counts as a vector. ``component_id``
    is the smallest id reachable (null for a null id), ``kept`` that it is the
    row's own. Other columns are not read.
    """
    v = F.col("vector")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & F.col("vec").isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))
    distinct = written(rows.where(usable).groupBy("label", "vector").agg(F.min("vec").alias("vec"), F.count("*").alias("weight")), "distinct")

    n = distinct.count()
    k = min(MOST, max(FEWEST, 2 * math.isqrt(n)))
    sample = [r.vector for r in distinct.select("vector", F.xxhash64("vec", "vector").alias("h")).orderBy("h").limit(k).collect()]
    points = np.zeros((max(1, len(sample)), max(map(len, sample), default=1)))
    for i, x in enumerate(sample):
        points[i, : len(x)] = x

    # with very few vectors all pivots describe each, and all pairs are candidates
    prefix = min(prefix, len(points))
    shared = min(shared, prefix)
    rank = ranking(points, prefix)
    shaped = distinct.select("vec", "weight", F.size("vector").alias("dim"), F.xxhash64("label", F.size("vector")).alias("place"), "vector")
    described = written(shaped.mapInArrow(partial(_described, pivots=points, rank=rank, prefix=prefix), _DESCRIBED), "described")
    # the places in a description of the first shared pivot, and of the second
    upto = prefix - shared + 1
    firsts = F.posexplode(F.slice("ranks", 1, upto)).alias("at", "first")
    seconds = F.explode(F.slice("ranks", F.col("at") + 2, F.lit(upto) - F.col("at"))).alias("second")
    blocks = F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")
    named = described.select("place", "ranks", firsts)
    longer = written(named.groupBy("place", "first").agg(F.count("*").alias("size"), blocks).where(F.col("size") > BLOCK), "lists")
    divided = longer.where(F.col("size") > LONG).select("place", "first")
    parts = named.join(divided, ["place", "first"]).select("place", "first", seconds)
    longer_parts = written(parts.groupBy("place", "first", "second").agg(F.count("*").alias("size"), blocks).where(F.col("size") > BLOCK).drop("size"), "parts")

    postings = described.select("place", "vec", "weight", "ranks", "vector", firsts).join(longer, ["place", "first"], "left")
    is_long = F.coalesce(F.col("size") > LONG, F.lit(False))
    short = postings.where(~is_long).select("place", "first", F.lit(-1).alias("second"), "vec", "weight", "ranks", "vector", "blocks")
    long = postings.where(is_long).drop("blocks").select("place", "first", seconds, "vec", "weight", "ranks", "vector").join(longer_parts, ["place", "first", "second"], "left")
    placed = short.unionByName(long.select(short.columns)).withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("vec"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = placed.select("place", "first", "second", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("own").alias("side"), "vec", "weight", "ranks", "vector")
    found = pairs.repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(partial(_joined, shared=shared, cosine=cosine), "vec long, n long, other long")
    found = written(found, "found")
    counts = found.groupBy("vec").agg(F.sum("n").alias("n"))
    ends = components(found.select("vec", "other"), "vec", "other")
    classes = distinct.join(counts, "vec", "left").join(ends, F.col("vec") == F.col("id"), "left")
    classes = written(classes.select("label", "vector", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component_id", "vec").alias("c")), "classes")
    # rows that link with nothing are dealt by their ids
    code = lambda own: F.when(own, F.xxhash64("label", "vector")).otherwise(F.xxhash64("vec"))
    out = rows.withColumn("code", code(usable)).join(classes.withColumn("code", F.xxhash64("label", "vector")), ["code", "label", "vector"], "left")
    component = F.when(F.col("vec").isNotNull(), F.coalesce("c", "vec"))
    return out.select(F.col("vec").alias(id_col), F.coalesce(F.when(F.col("vec").isNotNull(), F.col("n")), F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec"), F.lit(False)).alias("kept"))
