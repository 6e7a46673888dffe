"""The Merkle manifest against a plain tree in Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tideline.llm import merkle


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def digest(*values):
    parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values]
    return h("".join(parts))


def proofs(nodes):
    """(siblings by level as (left, right), top) of each node, as the definition says it."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = i // 3 * 3
            paths[k].append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 3])))
        nodes = [h("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
        at = [i // 3 for i in at]
    return paths, nodes[0] if nodes else None


def expected(rows):
    """rows of (source, id, leaf, found) -> sorted (id, leaf, subroot, root, siblings, folded)."""
    sources = sorted({r[0] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted((r for r in rows if r[0] == s), key=lambda r: (r[1] is not None, r[1] or 0, r[2])) for s in sources}
    made = {s: proofs([r[2] for r in own[s]]) for s in sources}
    over, root = proofs([made[s][1] for s in sources])
    out = []
    for s, upper in zip(sources, over, strict=True):
        for r, path in zip(own[s], made[s][0], strict=True):
            folded = r[3]
            for left, right in path + upper:
                folded = h(left + folded + right)
            out.append((repr(r[1]), r[2], made[s][1], root, "".join(a + b for a, b in path + upper), folded))
    return sorted(out)


def proven(leaves):
    got = merkle.prove(leaves).select("id", "leaf", "subroot", "root", merkle.siblings().alias("s"), merkle.fold("found").alias("f"))
    return sorted((repr(r.id), r.leaf, r.subroot, r.root, r.s, r.f) for r in got.collect())


LEAVES = "source string, id long, leaf string, found string"


@pytest.mark.parametrize("counts", [[1], [2], [3], [4], [81], [82], [243, 1, 80], [700, 9, 10, 1, 2], [1] * 100, [6600]])
def test_trees_of_every_shape(spark, counts):
    rows = [(None if k == 1 else f"s{k}", i * 7 - 3, h(f"{k}-{i}"), h(f"{k}-{i}" if i % 2 else "x")) for k, n in enumerate(counts) for i in range(n)]
    assert proven(spark.createDataFrame(rows, LEAVES).repartition(5)) == expected(rows)


def test_ties_nulls_and_equal_rows(spark):
    rows = [("é", 1, h("a"), h("a")), ("é", 1, h("b"), h("z")), ("z", 5, h("a"), h("a")), ("z", 5, h("a"), h("a")), (None, None, h("n"), h("n")), (None, None, h("m"), h("n")), (None, 0, h("m"), h("m")), ("", 2, h("e"), h("e"))]
    assert proven(spark.createDataFrame(rows, LEAVES)) == expected(rows)


def test_no_rows(spark):
    assert merkle.prove(spark.createDataFrame([], LEAVES)).count() == 0


def test_leaf_digest_and_tampering(docs, rows):
    columns = ("doc_id", "source", "lang", "n_chars", "text")
    cut = F.replace("text", F.lit("\n"), F.lit(""))
    leaves = docs.select("source", F.col("doc_id").alias("id"), merkle.leaf_digest(*map(F.col, columns)).alias("leaf"), merkle.leaf_digest(*map(F.col, columns[:-1]), cut).alias("found"))
    want = []
    for i, text, lang, source in rows:
        mine = [digest(i, source, lang, len(text or ""), t) for t in (text, text and text.replace("\n", ""))]
        want.append((source, i, *mine))
    assert proven(leaves) == expected(want)
    # what is not tampered with folds to the root, what is does not
    for r in merkle.prove(leaves).select("leaf", "found", "root", merkle.fold("found").alias("f")).collect():
        assert (r.f == r.root) == (r.leaf == r.found)


def test_checksum_of_the_query():
    import compare

    got = compare.oracle(f"SELECT doc_id, xor({merkle._CRC}, 4294967295) AS c FROM (VALUES (0), (17), (-4), (123456789012)) t(doc_id)", "/root/testdata/sf0.001").to_pylist()
    assert all(r["c"] == zlib.crc32(str(r["doc_id"]).encode()) for r in got)
