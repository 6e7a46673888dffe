"""Best-fit packing of documents into bins, with conflicts.

A bin holds ``capacity`` words, and neither two documents of one source nor two of
one duplicate cluster. Open bins are ordered by their residual and carry bitmaps
of the sources and clusters in them. A document, the largest first, goes to the
tightest bin that can take it: the search starts at the first bin with room and
goes on through its successors until one is compatible. A tree over the residuals
holds what all bins beneath a node have in common, so successors that all hold
the document's source or cluster are passed over at once.

Documents are dealt by a hash of the row to pools of bounded size, in words and in
rows, each packed by itself, so a source or cluster that holds a third of all rows
is spread evenly.
"""

from __future__ import annotations

from bisect import insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written

CAPACITY, POOL_WORDS, POOL_ROWS = 2048, 500_000, 8_192
WORD = r"[^\x20\x09-\x0D]+"


class OpenBins:
    """Open bins by residual, and within a residual by what they hold.

    A bitmap has a bit for each source and each cluster. A node of the tree is
    the intersection of the bitmaps beneath it; of no bins that is -1, all bits.
    """

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.common = [-1] * (2 * self.size)
        self.at: list[dict[int, list[int]]] = [{} for _ in range(self.size)]  # bitmap -> bins in order

    def _update(self, residual: int) -> None:
        node, common = self.size + residual, -1
        for held in self.at[residual]:
            common &= held
        while node and self.common[node] != common:
            self.common[node] = common
            node >>= 1
            common = self.common[2 * node] & self.common[2 * node + 1]

    def add(self, residual: int, held: int, bin_: int) -> None:
        insort(self.at[residual].setdefault(held, []), bin_)
        self._update(residual)

    def take(self, least: int, conflicts: int) -> tuple[int, int, int] | None:
        """Remove and return (residual, bitmap, bin) of the tightest bin with room for ``least`` and none of ``conflicts``, the first of equals."""
        residual = least
        while residual < self.size:
            node = self.size + residual
            if self.common[node] & conflicts:
                # pass over the largest subtree that begins here and conflicts throughout
                height = 0
                while not node & 1 and self.common[node >> 1] & conflicts:
                    node, height = node >> 1, height + 1
                residual = ((node + 1) << height) - self.size
                continue
            free = [(bins[0], held) for held, bins in self.at[residual].items() if not held & conflicts]
            if free:
                bin_, held = min(free)
                bins = self.at[residual][held]
                del bins[0]
                if not bins:
                    del self.at[residual][held]
                self._update(residual)
                return residual, held, bin_
            residual += 1
        return None


def best_fit(size: list[int], source: list[int], cluster: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each item, in the order given; sizes are from 1 to ``capacity``.

    Only clusters of several items need a bit: others conflict with nothing.
    """
    times = np.bincount(cluster) if len(cluster) else np.zeros(0, int)
    sources, several = max(source, default=0) + 1, np.flatnonzero(times > 1)
    bit = {c: 1 << (sources + i) for i, c in enumerate(several.tolist())}
    open_, made = OpenBins(capacity), 0
    bins, offsets = [], []
    for n, s, c in zip(size, source, cluster, strict=True):
        own = 1 << s | bit.get(c, 0)
        found = open_.take(n, own)
        if found is None:
            left, held, b = capacity, 0, made
            made += 1
        else:
            left, held, b = found
        bins.append(b)
        offsets.append(capacity - left)
        if left > n:
            open_.add(left - n, held | own, b)
    return bins, offsets


def _pack(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """The pieces of one pool: whole bins of long documents, then what is left, largest first."""
    empty = rows[rows["size"] == 0]
    rows = rows[rows["size"] > 0]
    pieces = -(-rows["size"].to_numpy() // capacity)
    of = np.repeat(np.arange(len(rows)), pieces)
    piece = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    out = pd.DataFrame({"row": rows["row"].to_numpy()[of], "piece": piece, "start": piece * capacity})
    out["n_words"] = np.minimum(capacity, rows["size"].to_numpy()[of] - out["start"].to_numpy())
    source, cluster = (pd.factorize(rows[c], use_na_sentinel=False)[0][of] for c in ("source", "cluster"))
    turn = np.lexsort((out["piece"], out["row"], -out["n_words"].to_numpy()))
    bins, offsets = best_fit(out["n_words"].to_numpy()[turn].tolist(), source[turn].tolist(), cluster[turn].tolist(), capacity)
    out.loc[turn, "bin"] = bins
    out.loc[turn, "offset"] = offsets
    none = pd.DataFrame({"row": empty["row"], "piece": 0, "start": 0, "n_words": 0, "bin": None, "offset": None})
    out = pd.concat([x for x in (out, none) if len(x)], ignore_index=True) if len(out) or len(none) else out
    return out.astype({"bin": "Int64", "offset": "Int64"}).assign(pool=int(rows["pool"].iloc[0] if len(rows) else empty["pool"].iloc[0]))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster: Column | None = None, capacity: int = CAPACITY, pool_words: int = POOL_WORDS, pool_rows: int = POOL_ROWS) -> DataFrame:
    """(id, piece, start, n_words, bin_id, offset), a row for each piece of each row.

    A document longer than ``capacity`` words is cut into pieces of that length,
    which fill bins, and a last one; ``start`` is a piece's first word, ``offset``
    its place in the bin. Without ``cluster``, equal texts form a cluster. Null and
    wordless texts keep a row with 0 words and no bin. Null sources are one
    source, null clusters one cluster. Repeated rows are packed once each (and
    never together); null ids are kept. Other columns are not read.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    own = F.xxhash64(F.col(text_col)) if cluster is None else cluster
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), own.alias("cluster"))
    rows = written(rows, "sizes")
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    pools = max(1, -(-total // pool_words), -(-n // pool_rows))
    dealt = rows.select("row", "source", "size", "cluster", F.pmod(F.xxhash64("row"), F.lit(pools)).alias("pool"))

    def pool(rows: pd.DataFrame) -> pd.DataFrame:
        return _pack(rows, capacity)

    packed = dealt.groupBy("pool").applyInPandas(pool, "row long, piece long, start long, n_words long, bin long, offset long, pool long")
    named = packed.join(rows.select("row", "id"), "row")
    return named.select(F.col("id").alias(id_col), "piece", "start", "n_words", (F.shiftleft("pool", 32) + F.col("bin")).alias("bin_id"), "offset")
