"""The audit of sources against plain loops over all pairs and terms."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import divergence


def expected(rows, least=3, top=200):
    """rows of (text, lang, source) -> the result, by the definition."""
    rows = [tuple(v or "" for v in r) for r in rows]
    count, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        own = [t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
        count[lang, source].update(own)
        docs[lang].update(set(own))
    out = []
    for lang in {r[1] for r in rows}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = {s for g, s in count if g == lang}

        def p(c, kept=kept):
            total = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // total for t in kept}

        own = {s: p(count[lang, s]) for s in sources}
        whole = p(sum((count[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(sum(f(own[s][t], own[o][t]) for t in kept), o) for o in sources - {s}]
            terms = [(f(own[s][t], whole[t]), t) for t in kept if count[lang, s][t] and own[s][t] > whole[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def got(frame, **how):
    return sorted(tuple(r) for r in divergence.audit(frame, **how).collect())


def test_odd_documents(docs, rows, none):
    assert got(docs) == expected([(r[1], r[2], r[3]) for r in rows])
    assert got(none) == []


@pytest.mark.parametrize("sources", [1, 2, 5, 8, 9, 13])
def test_rounds_meet_every_pair_once(spark, sources):
    g = np.random.default_rng(sources)
    words = [f"w{chr(97 + i)}é" for i in range(26)] + ["Zz", "aB", "x-y"]
    rows = [(" ".join(words[int(i)] for i in g.zipf(1.4, 30) % len(words)), "en" if k % 5 else "de", f"s{int(g.integers(sources))}") for k in range(150)]
    rows += [("", "en", "empty"), (None, None, None), ("only here", "fr", "a"), ("and there", "fr", "b")]
    frame = spark.createDataFrame(rows, "text string, lang string, source string")
    assert got(frame, slice_terms=4, seat_groups=2, top=6) == expected(rows, top=6)


@pytest.mark.parametrize("seats", range(1, 12))
def test_schedule(spark, seats):
    met = spark.range(seats).select(F.col("id").alias("seat"), F.explode(divergence.meetings("id", str(seats))).alias("m")).select("seat", "m.host", "m.round").collect()
    pairs = [frozenset((r.seat, r.host)) for r in met]
    assert len(pairs) == len(set(pairs)) == seats * (seats - 1) // 2 and all(len(p) == 2 for p in pairs)
    # nobody has two meetings in a round, and hosts are spread
    busy = Counter((r.round, s) for r in met for s in (r.seat, r.host))
    assert all(n == 1 for n in busy.values())
    hosts = Counter(r.host for r in met)
    assert max(hosts.values(), default=0) <= seats // 2 + 1


def test_shares_are_exact():
    g = np.random.default_rng(3)
    for total in (1, 2, 7, 10**9 + 7, 8 * 10**15):
        counts = np.append(g.integers(0, total, 200), [0, total - 1])
        assert divergence.shares(counts, total).tolist() == [1 + 10**9 * (int(c) + 1) // total for c in counts]


def test_vectors_survive_packing():
    places, counts = np.array([0, 3, 4, 900]), np.array([1, 2**40, 5, 1])
    back = divergence.unpacked(divergence.packed(places, counts))
    assert back[0].tolist() == places.tolist() and back[1].tolist() == counts.tolist()
    assert [len(x) for x in divergence.unpacked(None)] == [0, 0]


def test_terms_are_passed_on_before_they_are_many(spark, rows, docs, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 50)
    batch = docs.select("text", "lang", "source").na.fill("").toArrow().to_batches()
    parts = list(divergence._count(iter(batch)))
    assert len(parts) > 20
    total = Counter()
    for b in parts:
        for t, c in zip(b["term"].to_pylist(), b["count"].to_pylist(), strict=True):
            total[t] += c
    assert total == sum((Counter(x.decode() for x in divergence.terms_of(r[1])) for r in rows), Counter())
