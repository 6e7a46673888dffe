"""Removal of passages that occur earlier in the corpus, by super-k-mer partitioning.

A window is ``width`` consecutive words. Its minimiser is the smallest code among
its sequences of SEQUENCE words, the leftmost of equal ones; consecutive windows
that share it are a super-k-mer. Equal windows have equal minimisers at the same
place, so they lie in different super-k-mers of one code: a super-k-mer whose
code occurs once in the corpus repeats nothing and stays where it is. The others
are cut out as packed strings and travel to the bucket of their code, which sorts
their windows and keeps the earliest of each.

Codes are counted over all documents before strings are cut. A code that is
counted to be hot (a passage that very many documents hold) makes no bucket: its
windows travel one by one, each to the bucket of its own words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, written
from .words import codes_of, mixed, split, windows

#: Words in the sequences that minimisers are chosen from.
SEQUENCE = 8
#: A code is hot with more super-k-mers than this, and than one in HOT_SHARE of all: so at most HOT_SHARE codes are.
HOT, HOT_SHARE = 20_000, 100_000
#: Recurring strings that a task remembers from batch to batch, and words that a bucket sorts at once.
REMEMBERED, ROOM = 50_000, 1_000_000
LAST = (1 << 63) - 1

RUNS = "key long, doc long, row long, first int, n int"
PACKED = "key long, doc long, row long, first int, n int, packed binary"
SPANS = "doc long, row long, first int, stop int"


def _lowest(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    n, step = len(x) - width + 1, 1
    while 2 * step <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[:n], x[width - step : width - step + n])


def super_kmers(codes: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the super-k-mers of several texts (one after the other in ``codes``): text, first window, number of windows, code."""
    sequence = min(SEQUENCE, width)
    none = np.zeros(0, np.int64)
    if len(codes) < width:
        return none, none, none, none.astype(np.uint64)
    found = mixed(windows(codes, sequence), 7)
    places = np.uint64(max(24, len(found).bit_length()))
    ranked = (found >> places << places) | np.arange(len(found), dtype=np.uint64)
    low = (_lowest(ranked, width - sequence + 1) & ((np.uint64(1) << places) - np.uint64(1))).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(sizes)), sizes)[: len(low)]
    at = np.flatnonzero(np.arange(len(low)) - starts[of] <= sizes[of] - width)  # windows within one text
    if not len(at):
        return none, none, none, none.astype(np.uint64)
    first = np.flatnonzero(np.concatenate([[True], (low[at[1:]] != low[at[:-1]]) | (of[at[1:]] != of[at[:-1]])]))
    n = np.diff(np.append(first, len(at)))
    first = at[first]
    return of[first], first - starts[of[first]], n, found[low[first]]


def _runs(batches: Iterator[pa.RecordBatch], width: int, rows: int = 400) -> Iterator[pa.RecordBatch]:
    """The super-k-mers of a task's documents, without their words."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            part = batch.slice(k, rows)
            lists = [split(t) for t in part.column("text").to_pylist()]
            of, first, n, code = super_kmers(codes_of([w for words in lists for w in words]), np.array([len(x) for x in lists], np.int64), width)
            doc, row = (part.column(c).to_numpy()[of] for c in ("doc", "row"))
            yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(doc), pa.array(row), pa.array(first, pa.int32()), pa.array(n, pa.int32())], ["key", "doc", "row", "first", "n"])


def _cut(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The packed strings of the super-k-mers asked for, equal ones of a task once; those of hot codes window by window.

    Only the earliest of equal strings is sent; all windows of the others start
    earlier elsewhere, so these leave as decided spans (without a string).
    """
    known: dict[bytes, tuple] = {}
    for batch in batches:
        best: dict[bytes, tuple] = {}
        again: set[bytes] = set()
        spans: list[tuple] = []
        for doc, row, text, runs in zip(*(batch.column(c).to_pylist() for c in ("doc", "row", "text", "runs")), strict=True):
            words = split(text)
            wanted = []
            for r in runs:
                if r["hot"]:
                    wanted += [(first, 1, None) for first in range(r["first"], r["first"] + r["n"])]
                else:
                    wanted.append((r["first"], r["n"], r["key"]))
            for first, n, key in wanted:
                packed = b" ".join(words[first : first + n + width - 1])
                at = (doc, first, row, n, xxhash.xxh3_64_intdigest(packed) - (1 << 63) if key is None else key)
                was = best.get(packed)
                if was is None:
                    was = known.get(packed)
                    if was is None or at < was:
                        best[packed] = at
                    if was is None:
                        continue
                    again.add(packed)
                    if at > was:
                        spans.append(at)
                    continue
                again.add(packed)
                if at < was:
                    best[packed] = at
                    spans.append(was)
                elif at > was:
                    spans.append(at)
        for packed in again:
            if packed in best and (packed in known or len(known) < REMEMBERED):
                known[packed] = best[packed]
        rows = list(best.values())
        for part, strings in ((rows, list(best)), (spans, None)):
            for k in range(0, len(part), 20_000):
                doc, first, row, n, key = (np.array(x, np.int64) for x in zip(*part[k : k + 20_000], strict=True))
                if not strings:
                    key = (mixed(doc.view(np.uint64)) + first.view(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(doc), pa.array(row), pa.array(first, pa.int32()), pa.array(n, pa.int32()), pa.array(strings[k : k + 20_000], pa.binary()) if strings else pa.nulls(len(n), pa.binary())],
                    ["key", "doc", "row", "first", "n", "packed"],
                )


def _recurring(words: list[bytes], at: np.ndarray, code: np.ndarray, width: int) -> np.ndarray:
    """A group number for each window of a sorted run of equal codes; words decide, not codes."""
    new = np.concatenate([[True], code[1:] != code[:-1]])
    starts = at.tolist()
    for i in np.flatnonzero(~new).tolist():
        if words[starts[i - 1] : starts[i - 1] + width] != words[starts[i] : starts[i] + width]:
            break
    else:
        return np.cumsum(new)
    ids: dict[tuple, int] = {}  # two different windows share a code
    return np.array([ids.setdefault(tuple(words[i : i + width]), len(ids)) for i in starts])


def settle(doc: np.ndarray, row: np.ndarray, first: np.ndarray, n: np.ndarray, packed: list[bytes], width: int) -> tuple[np.ndarray, ...]:
    """Spans (doc, row, first word, word after the last) of windows that start earlier elsewhere."""
    words = b" ".join(packed).split()
    size = n + width - 1
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(np.cumsum(size) - size, n) + inner
    of = np.repeat(np.arange(len(n)), n)
    # codes need only agree within this task
    code = windows(np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64), width)[at]
    order = np.argsort(code)
    equal = code[order[1:]] == code[order[:-1]]
    order = order[np.concatenate([equal, [False]]) | np.concatenate([[False], equal])]
    removed = np.zeros(len(at), bool)
    if len(order):
        group = _recurring(words, at[order], code[order], width)
        d, s, r = doc[of[order]], first[of[order]] + inner[order], row[of[order]]
        turn = np.lexsort((r, s, d, group))
        order, group, d, s, r = order[turn], group[turn], d[turn], s[turn], r[turn]
        head = np.maximum.accumulate(np.where(np.concatenate([[True], group[1:] != group[:-1]]), np.arange(len(group)), 0))
        removed[order] = (d != d[head]) | (s != s[head]) | (r != r[head])
    edge = np.concatenate([[True], of[1:] != of[:-1]])
    begin = np.flatnonzero(removed & (edge | np.concatenate([[True], ~removed[:-1]])))
    end = np.flatnonzero(removed & np.concatenate([edge[1:] | ~removed[1:], [True]]))
    k = of[begin]
    return doc[k], row[k], first[k] + inner[begin], first[k] + inner[end] + width


def _settle(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Spans of buckets; batches come sorted by key, and a bucket is judged whole."""
    names = [x.split()[0] for x in SPANS.split(", ")]

    def out(*spans: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(spans, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names)

    def judged(t: pa.Table) -> pa.RecordBatch:
        doc, row, first, n = (t[c].to_numpy() for c in ("doc", "row", "first", "n"))
        return out(*settle(doc, row, first, n, t["packed"].to_pylist(), width))

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        decided = batch.filter(batch.column("packed").is_null())
        if decided.num_rows:
            first = decided.column("first").to_numpy()
            yield out(decided.column("doc"), decided.column("row"), first, first + decided.column("n").to_numpy() + width - 1)
        batch = batch.filter(batch.column("packed").is_valid())
        if not batch.num_rows:
            continue
        held.append(batch)
        size += int(batch.column("n").to_numpy().sum()) + (width - 1) * batch.num_rows
        if size < ROOM:
            continue
        t = pa.Table.from_batches(held)
        key = t["key"].to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            yield judged(t.slice(0, cut))
        rest = t.slice(cut).combine_chunks()
        held, size = rest.to_batches(), int(rest["n"].to_numpy().sum()) + (width - 1) * rest.num_rows
    if held:
        yield judged(pa.Table.from_batches(held))


def _kept(batches: Iterator[pa.RecordBatch], layout: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 1000):
            part = batch.slice(k, 1000)
            made = []
            for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                words = split(text)
                n = len(words)
                if spans:
                    step = np.zeros(n + 1, np.int64)
                    np.add.at(step, [x["first"] for x in spans], 1)
                    np.add.at(step, [x["stop"] for x in spans], -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()]
                same = text is None or layout and len(words) == n
                made.append((text if same else b" ".join(words).decode("utf-8", "surrogatepass"), n, n - len(words)))
            kept, n, gone = zip(*made, strict=True)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], ["doc_id", "text", "n_words", "n_removed"])


def _repeated(runs: DataFrame) -> DataFrame:
    """The super-k-mers whose code occurs more than once, marked as hot where it occurs very often.

    Hot codes are at most HOT_SHARE by their definition; they are broadcast, so
    their rows are never dealt by code.
    """
    counts = written(runs.groupBy("key").agg(F.count("*").alias("times")).where("times > 1"), "codes")
    often = max(HOT, runs.count() // HOT_SHARE)
    hot = F.broadcast(counts.where(F.col("times") > often).select("key"))
    cold = counts.where(F.col("times") <= often).select("key")
    rest = runs.join(hot, "key", "left_anti").join(cold, "key")
    return runs.join(hot, "key").withColumn("hot", F.lit(True)).unionByName(rest.withColumn("hot", F.lit(False)))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20, layout: bool = False) -> DataFrame:
    """(id, text, n_words, n_removed): every text without the words of windows that start earlier.

    A window starts earlier in a smaller id, or in the same document at an
    earlier word. All windows are judged on the input. The kept words are joined
    by single spaces; with ``layout``, a text that loses no word stays as it is.

    Null texts stay null with no words; texts of fewer than ``width`` words are
    kept whole. Null ids come last. Different texts under one id are ordered by
    the start of the window and then by a hash of the text; rows equal in id and
    text are treated alike, and neither is earlier than the other. Other columns
    are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.groupBy("doc_id").count().where("count > 1").limit(1).count()
    row = F.xxhash64("text") if shared else F.lit(0).cast("long")
    keyed = docs.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("doc"), row.alias("row"), "text")
    runs = written(keyed.select("doc", "row", "text").mapInArrow(partial(_runs, width=width), RUNS), "runs")
    wanted = _repeated(runs).groupBy("doc", "row").agg(F.collect_set(F.struct("first", "n", "key", "hot")).alias("runs"))
    wanted = written(wanted, "repeated")
    discard(runs)
    packed = keyed.select("doc", "row", "text").join(wanted, ["doc", "row"]).mapInArrow(partial(_cut, width=width), PACKED)
    spans = packed.repartition("key").sortWithinPartitions("key").mapInArrow(partial(_settle, width=width), SPANS)
    spans = written(spans, "spans").groupBy("doc", "row").agg(F.collect_set(F.struct("first", "stop")).alias("spans"))
    joined = keyed.join(spans, ["doc", "row"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(partial(_kept, layout=layout), "doc_id long, text string, n_words long, n_removed long").withColumnRenamed("doc_id", id_col)
