"""N-gram Jaccard join of documents by multiple-global-order filtering.

Every document is the set of its distinct word shingles. Sorted by one order of
all shingles, two sets with Jaccard similarity t share a shingle among the first
n - ceil(t n) + 1 of each, so a pair that shares none there is no pair. That
holds for *any* order, so a pair has to pass under several before it is
verified: under each it must share enough prefix shingles that, together with
all that can follow a prefix, the needed overlap is still possible. What two
sets share beyond the prefix that ends first lies in that set's remainder; which
one that is, is not kept, so the larger remainder counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .storage import discard, written
from .words import codes_of, mixed, shingle_set, split, windows

ORDERS = 2
#: Shingles that a task reports as frequent, and that are kept of all reports.
REPORTED, FREQUENT = 1 << 16, 1 << 18
#: In groups of more than LARGE documents, each is paired with a neighbour under its first SEEDS such shingles before all its candidates are.
LARGE, SEEDS = 256, 8
#: Marks a document as one of its block's component.
MEMBER = -(1 << 63)
#: Documents whose pairs are verified together, and rows that may be broadcast once they have been counted.
BUCKET, FEW = 512, 500_000


def _sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """The shingle set of each text."""
    lists = [split(t, lower=True) for t in texts]
    flat = codes_of([w for words in lists for w in words])
    shingles = windows(flat, width)
    out, at = [], 0
    for words in lists:
        n = len(words)
        out.append(np.unique(shingles[at : at + n - width + 1]) if n >= width else shingle_set(flat[at : at + n], width))
        at += n
    return out


def _parts(batches: Iterator[pa.RecordBatch], width: int, rows: int = 400) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            part = batch.slice(k, rows)
            yield part, _sets(part.column("text").to_pylist(), width)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in arrays], dtype=np.int64)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays).view(np.int64)))


def _report(batches: Iterator[pa.RecordBatch], width: int, room: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The shingles that recur most among a task's documents, counted chunk by chunk."""
    counts, held, size = Counter(), [], 0

    def count() -> None:
        found, n = np.unique(np.concatenate(held), return_counts=True)
        often = np.flatnonzero(n > 2)
        often = often[np.argsort(-n[often], kind="stable")][:REPORTED]
        counts.update(dict(zip(found[often].tolist(), n[often].tolist(), strict=True)))

    for _, sets in _parts(batches, width):
        held += sets
        size += sum(map(len, sets))
        if size >= room:
            count()
            held, size = [], 0
    if held:
        count()
    top = counts.most_common(REPORTED)
    yield pa.RecordBatch.from_arrays([pa.array(np.array([t for t, _ in top], np.uint64).view(np.int64)), pa.array([c for _, c in top], pa.int64())], ["token", "n"])


def frequent_shingles(texts: DataFrame, width: int) -> np.ndarray:
    """At most FREQUENT shingles that very many documents hold, found over all documents.

    Each task reports its most frequent ones and the sums decide. The orders put
    them last. Any set would do for correct results; a good one keeps shared
    passages out of the prefixes.
    """
    told = texts.select("text").mapInArrow(partial(_report, width=width), "token long, n long")
    top = told.groupBy("token").agg(F.sum("n").alias("n")).where("n >= 20").orderBy(F.desc("n"), "token").limit(FREQUENT).toArrow()
    return np.sort(top["token"].to_numpy().astype(np.int64).view(np.uint64))


def prefix_length(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    return n - (-(-percent * n // 100)) + 1


def _describe(batches: Iterator[pa.RecordBatch], width: int, percent: int, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    import xxhash

    low = np.uint64((1 << 20) - 1)
    maybe = np.zeros(1 << 20, bool)
    maybe[(frequent & low).astype(np.int64)] = True
    for part, sets in _parts(batches, width):
        n = np.array([len(s) for s in sets], np.int64)
        keys = np.array([(xxhash.xxh3_64_intdigest(b := s.tobytes()), xxhash.xxh3_64_intdigest(b, seed=1)) for s in sets], np.uint64).view(np.int64)
        flat = np.concatenate(sets)
        late = np.flatnonzero(maybe[(flat & low).astype(np.int64)])
        late = late[np.isin(flat[late], frequent)]
        starts = np.cumsum(n) - n
        orders = []
        for o in range(ORDERS):
            rank = mixed(flat, o + 1) >> np.uint64(1)
            rank[late] |= np.uint64(1 << 63)
            first = []
            for s, at in zip(sets, starts.tolist(), strict=True):
                if not len(s):
                    first.append(s)
                    continue
                p, own = prefix_length(len(s), percent), rank[at : at + len(s)]
                k = np.argpartition(own, p - 1)[:p] if p < len(s) else np.arange(len(s))
                first.append(s[k[np.argsort(own[k])]])
            orders.append(_lists(first))
        yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(n), pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy()), *orders], ["doc", "n", "hi", "lo", *(f"order{o}" for o in range(ORDERS))])


def _whole_sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for part, sets in _parts(batches, width):
        yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("blocks"), _lists(sets)], ["doc", "blocks", "shingles"])


def _linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links of blocks that come sorted: first each document's set, then the pairs to verify.

    Pairs that links of the same block connect already are not compared, so what
    leaves a block is a forest.
    """
    block, sets, root, members = None, {}, {}, []

    def similar(a: int, b: int) -> bool:
        for x in sets.get(a, ()):
            for y in sets.get(b, ()):
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * common >= percent * (len(x) + len(y) - common):
                        return True
        return False

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for batch in batches:
        found = []
        values, ends = batch.column("shingles").values.to_numpy(), batch.column("shingles").offsets.to_numpy()
        for i, (key, a, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("block", "a", "b")), strict=True)):
            if key != block:
                block, sets, root, members = key, {}, {}, []
            if b is None:
                sets.setdefault(a, []).append(values[ends[i] : ends[i + 1]].copy())
            elif b == MEMBER:  # these come before all pairs
                members.append(a)
            elif a == b:  # against all members, which are of one component
                for c in members:
                    if similar(a, c):
                        root[find(a)] = find(c)
                        found.append((a, c))
                        break
            elif find(a) != find(b) and similar(a, b):
                root[find(a)] = find(b)
                found.append((a, b))
        if found:
            a, b = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _semi(rows: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows with (or without) the ids; these are broadcast if they have been counted to be few, and joined otherwise."""
    few = ids.count() <= FEW
    return rows.join(F.broadcast(ids) if few else ids, "doc", how)


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links among the pairs (block, a, b; with b MEMBER, a is of the block's component; with b = a, it is compared with all these): enough of those with similar enough sets to connect the same documents.

    Each set travels once to a block. The documents' blocks are broadcast if they
    have been counted to be few.
    """
    wanted = pairs.select("block", F.col("a").alias("doc")).union(pairs.where(F.col("b") != MEMBER).select("block", "b")).groupBy("doc").agg(F.collect_set("block").alias("blocks"))
    wanted = written(wanted, "wanted")
    few = (wanted.agg(F.sum(F.size("blocks"))).first()[0] or 0) <= FEW
    sets = texts.join(F.broadcast(wanted) if few else wanted, "doc").select("doc", "text", "blocks").mapInArrow(partial(_whole_sets, width=width), "doc long, blocks array<long>, shingles array<long>")
    rows = sets.select(F.explode("blocks").alias("block"), F.col("doc").alias("a"), F.lit(None).cast("long").alias("b"), "shingles")
    rows = rows.unionByName(pairs.select("block", "a", "b", F.array().cast("array<long>").alias("shingles")))
    return rows.repartition("block").sortWithinPartitions("block", F.col("b").isNotNull(), "b").mapInArrow(partial(_linked, percent=percent), "a long, b long")


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[dict[str, np.ndarray]]:
    """The columns of one or more whole groups at a time, of batches sorted by ``key``."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
        if rest is not None:
            now = {c: np.concatenate([rest[c], now[c]]) for c in now}
        cut = int(np.flatnonzero(now[key] != now[key][-1])[-1]) + 1 if now[key][0] != now[key][-1] else 0
        if cut:
            yield {c: x[:cut] for c, x in now.items()}
        rest = {c: x[cut:] for c, x in now.items()}
    if rest is not None:
        yield rest


def _cross_pairs(batches: Iterator[pa.RecordBatch], percent: int, room: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Pairs of documents of one shingle whose sizes allow a link and whose components differ.

    A component of several documents is not paired one by one: a document outside
    is paired with the component as a whole (na is 0, b the component). What is
    linked already is never paired.
    """
    made, size = [], 0

    def flush() -> pa.RecordBatch:
        a, b, na, nb, ca, cb, ba, bb = (np.concatenate(x) for x in zip(*made, strict=True))
        turn = (a > b) & (na > 0)
        sides = ((b, a), (a, b), (nb, na), (na, nb))
        # a block is a pair of buckets of labels; with a label in one part, the smaller label of the two
        x, y = (mixed(c.view(np.uint64), 3) + mixed(d.view(np.uint64), 4) % np.maximum(n, 1).astype(np.uint64) for c, d, n in ((ca, a, ba), (cb, b, bb)))
        low, high = np.minimum(x, y), np.maximum(x, y)
        one, two = (np.where(bb > 0, np.where(ba > 0, z, y), np.where(ba > 0, x, low)) for z in (low, high))
        block = mixed(one, 5) + two
        return pa.RecordBatch.from_arrays([*(pa.array(np.where(turn, x, y)) for x, y in sides), pa.array(block.view(np.int64))], ["a", "b", "na", "nb", "block"])

    for g in _groups(batches, "token"):
        bounds = np.flatnonzero(np.diff(g["token"])) + 1
        for s, e in zip([0, *bounds], [*bounds, len(g["token"])], strict=True):
            if e - s < 2 or g["component"][s] == g["component"][e - 1]:
                continue
            doc, n, comp, cluster, buckets, several = (g[c][s:e] for c in ("doc", "n", "component", "cluster", "buckets", "several"))
            whole, at = np.unique(comp[several], return_index=True)
            for c, b in zip(whole.tolist(), buckets[several][at].tolist(), strict=True):
                x = doc[(comp != c) & (~several | (comp > c))]
                fill = lambda v: np.full(len(x), v, np.int64)  # noqa: B023, E731
                made.append((x, fill(c), fill(0), fill(0), fill(0), fill(c), fill(0), fill(b)))
                size += len(x)
            doc, n, cluster, buckets = (x[~several] for x in (doc, n, cluster, buckets))
            for i in range(len(doc) - 1):
                m = n[i + 1 :]
                near = i + 1 + np.flatnonzero(100 * np.minimum(m, n[i]) >= percent * np.maximum(m, n[i]))
                if len(near):
                    made.append(tuple(y for x in (doc, n, cluster, buckets) for y in (np.full(len(near), x[i]), x[near])))
                    size += len(near)
                    if size >= room:
                        yield flush()
                        made, size = [], 0
    if made:
        yield flush()


def _possible(shared: Column, percent: int) -> Column:
    """Whether ``shared`` prefix shingles still allow the overlap that a link needs."""
    prefix = lambda n: n - F.ceil(n * percent / 100) + 1
    na, nb = F.col("na"), F.col("nb")
    left = F.greatest(na - prefix(na), nb - prefix(nb))
    return (shared + left) * (100 + percent) >= percent * (na + nb)


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, class_id) of every document.

    Two documents link when 100 |x & y| >= percent |x | y|; ``component_id`` is the
    smallest id reachable by links. Equal sets form a class, whose smallest id
    (``class_id``) stands for it, so copies are never paired. Of each shingle's
    documents, neighbours under a few first shingles are verified first; what
    then remains is only pairs between different components.

    Null and wordless texts have no shingles and link with nothing. A null id
    keeps its row with a null component. Rows that share an id are one document
    with all links of its texts. Other columns are not read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    frequent = frequent_shingles(texts, width)
    arrays = ", ".join(f"order{o} array<long>" for o in range(ORDERS))
    described = written(texts.mapInArrow(partial(_describe, width=width, percent=percent, frequent=frequent), f"doc long, n long, hi long, lo long, {arrays}"), "described")
    slim = described.select("doc", "n", "hi", "lo")
    classes = written(slim.where("n > 0 and doc is not null").groupBy("hi", "lo").agg(F.min("doc").alias("rep"), F.count("*").alias("copies")), "classes")
    several = classes.where("copies > 1").select("hi", "lo", "rep")
    classed = written(slim.join(several, ["hi", "lo"], "left").select("doc", "n", F.coalesce("rep", F.when(F.col("n") > 0, F.col("doc"))).alias("rep")), "classed")
    others = written(classed.where("doc != rep").select("doc").distinct(), "copies")
    firsts = _semi(described, others, "left_anti").where("doc is not null and n > 0").drop("hi", "lo")

    postings = []
    for o in range(ORDERS):
        each = firsts.select("doc", "n", F.posexplode(f"order{o}").alias("pos", "token"))
        w = Window.partitionBy("token").orderBy("n", "doc")
        by = lambda k: F.lag("doc", k).over(w).isNotNull() | F.lead("doc", k).over(w).isNotNull()  # noqa: B023, E731
        each = each.withColumns({"shared": by(1), "large": by(LARGE // 2)}).where("shared").drop("shared")
        postings.append(written(each, f"postings{o}"))
    discard(described)

    # each document's first shingles of large groups, under each order
    own = Window.partitionBy("doc").orderBy("pos")
    starts = []
    for o, p in enumerate(postings):
        first = p.where("large").withColumn("r", F.row_number().over(own)).where(F.col("r") <= SEEDS)
        starts.append(first.select(F.lit(o).alias("o"), "token", "doc", "n"))
    starts = written(reduce(DataFrame.union, starts), "starts")

    # neighbours in a random order of each shingle's documents of about one size; they connect most of what is similar
    w = Window.partitionBy("o", "token").orderBy(F.floor(F.log(F.col("n").cast("double")) * 8), F.xxhash64("doc", "token"))
    pairs = starts.withColumns({"before": F.lag(F.struct("doc", "n")).over(w), "part": F.floor(F.row_number().over(w) / BUCKET)})
    pairs = pairs.where((F.col("before.doc") != F.col("doc")) & (F.least("n", "before.n") * 100 >= F.greatest("n", "before.n") * percent))
    pairs = pairs.select(F.xxhash64("o", "token", "part").alias("block"), F.least("doc", "before.doc").alias("a"), F.greatest("doc", "before.doc").alias("b"))
    pairs = written(pairs.groupBy("a", "b").agg(F.min("block").alias("block")), "seeds")
    known = written(components(_verified(pairs, texts, width, percent), "a", "b"), "components")

    # pairs are verified by component, or else by the first shingle that few documents share with a document, or that many do
    sizes = known.groupBy("component_id").agg(F.ceil(F.count("*") / BUCKET).alias("buckets"))
    linked = known.join(sizes, "component_id")
    few = written(postings[0].groupBy("doc").agg(F.min_by("token", F.struct("large", "pos")).alias("few"), F.min("large").alias("none")), "few")
    crowds = few.where("none").groupBy("few").agg(F.ceil(F.count("*") / BUCKET).alias("parts"))
    few = few.join(crowds, "few", "left")
    labels = few.join(linked, F.col("doc") == F.col("id"), "full_outer").select(F.coalesce("doc", "id").alias("of"), "few", "none", "parts", "component_id", "buckets")
    buckets = F.coalesce("buckets", F.when(F.col("none"), F.col("parts")), F.lit(0)).cast("long")
    labels = written(labels.select("of", F.coalesce("component_id", "few", "of").alias("cluster"), buckets.alias("buckets"), F.coalesce("component_id", "of").alias("component"), F.col("component_id").isNotNull().alias("several")), "labels")
    counted = []
    for o, p in enumerate(postings):
        labelled = p.join(labels, F.col("doc") == F.col("of"), "left").select("token", "doc", "n", *(F.coalesce(c, "doc").alias(c) for c in ("component", "cluster")), F.coalesce("buckets", F.lit(0)).cast("long").alias("buckets"), F.coalesce("several", F.lit(False)).alias("several"))
        pairs = labelled.repartition("token").sortWithinPartitions("token", "component", "doc").mapInArrow(partial(_cross_pairs, percent=percent), "a long, b long, na long, nb long, block long")
        counted.append(pairs.select("*", *(F.lit(int(i == o)).alias(f"c{i}") for i in range(ORDERS))))
    # a pair has to pass under every order
    counts = reduce(DataFrame.union, counted).groupBy("block", "a", "b", "na", "nb").agg(*(F.sum(f"c{o}").alias(f"c{o}") for o in range(ORDERS)))
    passing = reduce(Column.__and__, [(F.col(f"c{o}") > 0) & ((F.col("na") == 0) | _possible(F.col(f"c{o}"), percent)) for o in range(ORDERS)])
    passed = written(counts.where(passing).select("block", "a", "b", "na"), "candidates")
    # a document and a component meet in each of the component's buckets, to which its members come
    bucket = lambda c, d, n: F.xxhash64(c, F.pmod(F.xxhash64(d), n))
    probes = passed.where("na = 0").select(F.col("a").alias("doc"), F.col("b").alias("component_id")).distinct().join(sizes, "component_id")
    probes = written(probes.select("doc", "component_id", "buckets"), "probes")
    asked = known.join(probes.select("component_id", "buckets").distinct(), "component_id").select(bucket(F.col("component_id"), F.col("id"), F.col("buckets")).alias("block"), F.col("id").alias("a"), F.lit(MEMBER).cast("long").alias("b"))
    parts = probes.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1))).select(F.xxhash64("component_id", F.col("i")).alias("block"), F.col("doc").alias("a"), F.col("doc").alias("b"))
    rest = written(passed.where("na > 0").select("block", "a", "b").unionByName(asked).unionByName(parts), "rest")
    more = _verified(rest, texts, width, percent)
    # links to what is known already are links to its component
    stars = known.where("id != component_id").select(F.col("id").alias("a"), F.col("component_id").alias("b"))
    final = written(components(stars.union(more), "a", "b"), "components")
    return classed.join(final, F.col("rep") == F.col("id"), "left").select(
        F.col("doc").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc").isNotNull(), F.coalesce("component_id", "rep", "doc")).alias("component_id"),
        F.coalesce("rep", "doc").alias("class_id"),
    )
