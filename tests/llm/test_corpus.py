"""Mixing, vectors, shards, packing, host reputation, the classifier, and the pipeline."""

import os
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tideline.llm import components, host_reputation, mixing, near_vectors, packing, quality_model, quality_rules, shards


def test_components(spark):
    g = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in g.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            p, q = sorted((find(a), find(b)))
            root[q] = p
    got = {r.id: r.component_id for r in components.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in list(root)}


def test_mix(docs, rows):
    got = mixing.mix(docs).toPandas()
    again = mixing.mix(docs.repartition(5)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert sorted(map(repr, got[key].values.tolist())) == sorted(map(repr, again[key].values.tolist()))
    assert len(got) == len(rows) and (got.taken <= 3 * got["size"]).all() and (got.taken % got["size"].clip(lower=1) == 0).all()
    # targets by filling up one source after the other
    sizes = got.groupby("source", dropna=False)["size"].sum()
    names = sorted(x for x in sizes.index if isinstance(x, str)) + [x for x in sizes.index if not isinstance(x, str)]
    weight = {n: i % 3 + 1 for i, n in enumerate(names)}
    target, free, left = {}, set(names), float(sizes.sum())
    while True:
        level = left / sum(weight[n] for n in free)
        over = [n for n in free if weight[n] * level > 3 * sizes[n]]
        if not over:
            break
        for n in over:
            target[n] = 3.0 * sizes[n]
            left -= target[n]
            free.discard(n)
    target |= {n: weight[n] * level for n in free}
    for n in names:
        own = got[got.source.isna()] if not isinstance(n, str) else got[got.source == n]
        assert own.target.iloc[0] == pytest.approx(target[n])
        assert abs(own.taken.sum() - target[n]) <= own["size"].max()


def test_mix_of_nothing(spark, none):
    assert mixing.mix(none).count() == 0
    assert [r.taken for r in mixing.mix(spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")).collect()] == [0, 0]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, vec string, weight string")


def test_vectors_match_brute_force(spark):
    g = np.random.default_rng(7)
    rows = []
    centres = g.normal(size=(30, 16))
    for i in range(900):
        v = centres[i % 30] + g.normal(size=16) * (0.04 if i % 3 else 0.6)
        rows.append((i, [float(np.float32(x)) for x in v], i % 2, "x", "y"))
    rows += [(2000 + i, rows[4][1], 0, "x", "y") for i in range(3)]
    rows += [(3000, None, 0, "", ""), (3001, [0.0] * 16, 0, "", ""), (3002, rows[4][1], None, "", ""), (3003, [1.0, None], 0, "", ""), (3004, [float("nan")] * 16, 0, "", ""), (3005, [], 0, "", ""), (3006, [1.0, 2.0], 0, "", ""), (None, rows[4][1], 0, "", "")]
    got = near_vectors.link_vectors(vectors(spark, rows)).toPandas()
    assert len(got) == len(rows) and (got[got.vec_id >= 3000].n_links == 0).all()
    good = [r for r in rows if r[0] is not None and r[0] < 3000]
    e = np.array([r[1] for r in good])
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    lab = np.array([r[2] for r in good])
    link = (e @ e.T >= 0.98) & (lab[:, None] == lab)
    n = dict(zip([r[0] for r in good], link.sum(1) - 1, strict=True))
    have = got[got.vec_id.notna()].set_index("vec_id").n_links
    assert all(have[i] <= n[i] for i in n) and sum(have[i] for i in n) >= 0.9 * sum(n.values())
    assert have[4] >= 3 and have[2000] == have[4]
    kept = got[got.vec_id.notna()]
    assert (kept.kept == (kept.vec_id == kept.component_id)).all()


@pytest.mark.parametrize("long", [40, 2048])
def test_recall_just_above_the_threshold(spark, monkeypatch, long):
    """Pairs planted at cosines from 0.9805 to 0.985, with lists divided by their second pivot, and not; nothing below counts."""
    monkeypatch.setattr(near_vectors, "LONG", long)
    monkeypatch.setattr(near_vectors, "BLOCK", 16)
    g = np.random.default_rng(12)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    base = unit(g.normal(size=(1500, 32)))
    aside = unit(g.normal(size=base.shape))
    aside = unit(aside - (aside * base).sum(1)[:, None] * base)
    c = np.concatenate([g.uniform(0.9805, 0.985, 1000), g.uniform(0.95, 0.9795, 500)])[:, None]
    e = np.vstack([base, c * base + np.sqrt(1 - c * c) * aside])
    rows = [(i, v.tolist(), 1, "x", "y") for i, v in enumerate(e)]
    got = near_vectors.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, vec string, weight string")).toPandas().set_index("vec_id").sort_index().n_links
    link = (e @ e.T >= 0.98).sum(1) - 1
    assert (got.to_numpy() <= link).all() and got.sum() >= 0.95 * link.sum() and link.sum() >= 2000


def test_vectors_of_nothing(spark):
    assert near_vectors.link_vectors(vectors(spark, [])).count() == 0
    two = near_vectors.link_vectors(vectors(spark, [(1, [1.0, 0.0], 0, "", ""), (2, [1.0, 0.01], 0, "", "")])).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in two) == [(1, 1, 1), (2, 1, 1)]


def test_recall_on_the_table(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = near_vectors.link_vectors(e).toPandas().set_index("vec_id")
    t = e.toPandas()
    x = np.array(t.embedding.tolist(), float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = (x @ x.T >= 0.98) & (t.label.to_numpy()[:, None] == t.label.to_numpy())
    n = link.sum(1) - 1
    assert got.n_links[t.vec_id].sum() >= 0.9 * n.sum() and (got.n_links[t.vec_id].to_numpy() <= n).all()


def test_shards_round_trip(spark, docs, tmp_path):
    table = shards.arrive(spark, docs, str(tmp_path / "t"), F.pmod(F.xxhash64("doc_id"), F.lit(3)), 3, target=1 << 20)
    key = lambda df: sorted(map(repr, df.select(docs.columns).collect()))
    assert key(table.read()) == key(docs)
    before = table.version()
    table.append(docs.limit(5))
    assert table.version() == before + 1 and table.read().count() == docs.count() + 5
    assert len(spark.read.schema(docs.schema).parquet(*(s.path for s in table.shards(before))).take(1)) == 1
    with pytest.raises(shards.Conflict):
        table.commit(before + 1, [], [])
    assert table.version() == before + 1


def test_compaction_leaves_no_full_tier(spark, tmp_path):
    rows = spark.range(1000).select("id", F.repeat(F.sha2(F.col("id").cast("string"), 256), 20).alias("t"))
    table = shards.ShardTable(spark, str(tmp_path / "t"), rows.schema, target=2 << 20, fan_in=3)
    for k in range(7):
        table.append(rows.where(F.col("id") % 7 == k).coalesce(1))
    assert len(table.shards()) == 7 and table.compact() >= 1
    tiers = [table.tier(s) for s in table.shards() if s.bytes < 1 << 20]
    assert max((tiers.count(t) for t in tiers), default=0) < 3
    assert table.read().select("id").distinct().count() == 1000 and table.read().count() == 1000
    table.vacuum()
    assert table.read().count() == 1000


class Unset:
    """A session that names no folder; ``master`` says whether it is on one machine."""

    def __init__(self, master):
        self.conf, self.sparkContext, self.master, self.applicationId = {}, self, master, "app-test"

    def getConf(self):
        return {}


def test_own_folder_where_none_is_set():
    from tideline.llm import storage

    assert os.path.isdir(storage.shared_dir(Unset("local[4]"))) and storage.shared_dir(Unset("local[4]")) == storage.shared_dir(Unset("local[4]"))
    with pytest.raises(ValueError, match="shared|share"):
        storage.shared_dir(Unset("spark://host:7077"))


def test_shards_keep_columns_of_any_name(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"a{i}", f"s{i}", f"m{i}", None if i % 2 else i) for i in range(9)], "id long, Arrival string, _shard string, _metadata string, ARRIVAL_ int")
    table = shards.arrive(spark, rows, str(tmp_path / "t"), F.col("id") % 3, 3)
    assert sorted(map(tuple, table.read().select(rows.columns).collect())) == sorted(map(tuple, rows.collect()))
    assert table.shard_column.lower() not in {c.lower() for c in rows.columns} and table.read().where(F.col(table.shard_column).isNull()).count() == 0


def test_shards_of_two_writers(spark, tmp_path):
    """Both appends stay; a merge whose shards another has merged is given up; old versions read as they were."""
    rows = spark.range(40).toDF("id")
    one, two = (shards.ShardTable(spark, str(tmp_path / "t"), rows.schema, fan_in=3) for _ in range(2))
    for k in range(4):
        (one, two)[k % 2].append(rows.where(F.col("id") % 4 == k).coalesce(1))
    assert one.version() == two.version() == 4
    small = one.small()
    assert two.compact() == 1
    assert not one.replace(small, rows)
    assert sorted(r.id for r in two.read().collect()) == list(range(40)) and len(one.shards(4)) == 4
    for k in range(shards.SNAPSHOT):
        one.append(spark.range(100 + k, 101 + k).toDF("id").coalesce(1))
    assert two.read().count() == 40 + shards.SNAPSHOT and len(one.shards(4)) == 4


def test_shards_of_nothing(spark, none, tmp_path):
    table = shards.arrive(spark, none, str(tmp_path / "t"), F.lit(0), 1)
    assert table.version() == 0 and table.read().count() == 0


def naive(size, source, cluster, capacity):
    bins = []
    out = []
    for n, s, c in zip(size, source, cluster, strict=True):
        fits = [(b["left"], k) for k, b in enumerate(bins) if b["left"] >= n and s not in b["s"] and c not in b["c"]]
        if fits:
            k = min(fits)[1]
        else:
            bins.append({"left": capacity, "s": set(), "c": set()})
            k = len(bins) - 1
        bins[k]["left"] -= n
        bins[k]["s"].add(s)
        bins[k]["c"].add(c)
        out.append(k)
    return out


@pytest.mark.parametrize(("sources", "clusters", "largest"), [(12, 300, 99), (1, 400, 60), (40, 5, 30), (3, 2, 3), (30, 400, 100)])
def test_best_fit_is_the_naive_one(sources, clusters, largest):
    g = np.random.default_rng(9)
    size = sorted(g.integers(1, largest + 1, 500).tolist(), reverse=True)
    source, cluster = g.integers(0, sources, 500).tolist(), g.integers(0, clusters, 500).tolist()
    assert packing.best_fit(size, source, cluster, 100)[0] == naive(size, source, cluster, 100)


def test_best_fit_of_one_source_is_not_quadratic():
    def seconds(n):
        began = time.perf_counter()
        assert len(set(packing.best_fit([1] * n, [0] * n, [0] * n, 2048)[0])) == n
        return time.perf_counter() - began

    assert seconds(20_000) < 2 and seconds(40_000) < 10 * seconds(10_000) + 1


def test_clusters_never_share_a_bin(spark, docs):
    got = packing.pack(docs, cluster=F.length("text") % 5, capacity=500, pool_words=50_000).where("n_words > 0").toPandas()
    lengths = {r.doc_id: r.l for r in docs.select("doc_id", (F.length("text") % 5).alias("l")).collect()}
    for _, b in got[got.doc_id.notna()].groupby("bin_id"):
        own = [lengths[i] for i in b.doc_id]
        assert len(own) == len(set(own))
    assert packing.pack(docs, pool_rows=20).select("bin_id").distinct().count() > 1


def test_pack(docs, rows):
    got = packing.pack(docs, capacity=500, pool_words=5000).toPandas()
    assert len(got[got.piece == 0]) == len(rows)
    used = got[got.n_words > 0]
    assert used.groupby("bin_id").n_words.sum().max() <= 500 and used.bin_id.notna().all() and got[got.n_words == 0].bin_id.isna().all()
    import re

    assert used.n_words.sum() == sum(len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows)
    for _, b in used.sort_values("offset").groupby("bin_id"):
        assert (b.offset.to_numpy()[1:] >= (b.offset + b.n_words).to_numpy()[:-1]).all()
    source = {r[0]: r[3] for r in rows}
    for _, b in used[used.doc_id.notna()].groupby("bin_id"):
        own = [source[i] for i in b.doc_id]
        assert len(own) == len(set(own))


def test_pack_of_nothing(none):
    assert packing.pack(none).count() == 0


def test_urls(spark):
    urls = ["HTTP://A.Example.ORG/es/1", "http://org/x", "http://xorg/x", "http://b.com?q", "http://b.com/fr/x?y#z", "nothing", None, "", "http://example.org/en/1", "http://Ex.com/de/", "http://u@h.org:80/a", "x://"]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)] + [(None, "http://b.com/", "z")], "page_id long, url string, host string")
    out = spark.createDataFrame([(0, True), (0, None), (1, False), (None, True)], "id long, good boolean")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in host_reputation.judge_urls(pages, out, host_reputation.RULES).collect()}
    assert got[0] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[1] == ("org", "/x", "org/", "allow") and got[2][2] is None and got[3][:3] == ("b.com", "", None)
    assert got[4] == ("b.com", "/fr/x", "com/fr/", "allow") and got[5][:3] == got[6][:3] == ("", "", None)
    assert got[8][2:] == ("example.org/en/1", "block") and got[9][2:] == ("com/de/", "block")
    assert got[10] == ("u@h.org:80", "/a", None, "allow") and len(got) == 13


def test_reputation_blocks_only_beyond_doubt(spark):
    rows = [("bad.spam.net", False)] * 60 + [("few.spam.net", False)] * 2 + [(f"h{i}.fine.net", j % 10 > 0) for i in range(20) for j in range(40)] + [("new.fine.net", None)] * 5
    got = {r.host: r for r in host_reputation.reputation(spark.createDataFrame(rows, "host string, good boolean")).collect()}
    assert got["bad.spam.net"].bad and not got["h3.fine.net"].bad and not got["new.fine.net"].bad
    assert got["bad.spam.net"].good < got["few.spam.net"].good < got["new.fine.net"].good


def test_posterior_is_the_beta_distribution(spark):
    """Against sums of binomial terms, which the distribution is for whole numbers; and a case by quadrature."""
    from math import comb, lgamma

    whole = [(1, 5), (3, 9), (40, 61), (400, 500), (2, 300)]
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in whole] + [(2.5, 7.25)], "a double, b double")
    got = [tuple(r) for r in rows.select(host_reputation.upper_tail(F.col("a"), F.col("b"), 0.5), host_reputation.log_gamma(F.col("a"))).collect()]
    for (a, b), (tail, gamma) in zip(whole, got, strict=False):
        n = a + b - 1
        assert tail == pytest.approx(sum(comb(n, k) for k in range(a)) / 2**n, rel=1e-8) and gamma == pytest.approx(lgamma(a), abs=1e-10)
    x = (np.arange(400_000) + 0.5) / 400_000
    density = x**1.5 * (1 - x) ** 6.25
    assert got[-1][0] == pytest.approx(density[200_000:].sum() / density.sum(), rel=1e-6)


def test_suffix_file_and_clashing_names(spark, tmp_path):
    (tmp_path / "list.dat").write_text("// comment\ncom\nco.uk\n*.ck\n!www.ck\na.b.c\nCOM.tr\n")
    assert host_reputation.read_suffixes(spark, str(tmp_path / "list.dat")) == ("co.uk", "com.tr")
    long = "http://x.co.uk/" + "a" * 100_000
    pages = spark.createDataFrame([(1, long, 7, "d", "s", "p", "r"), (1, long, 8, "d", "s", "p", "r")], "page_id long, url string, id int, domain string, suffix string, path string, rule string")
    got = host_reputation.judge_urls(pages, spark.createDataFrame([], "id long, good boolean"), host_reputation.RULES).collect()
    assert len(got) == 2 and all(len(r.path) == 100_001 and r.verdict == "allow" for r in got)


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert host_reputation.judge_urls(pages, spark.createDataFrame([], "id long, good boolean"), host_reputation.RULES).count() == 0


def test_classifier_on_held_out_labels(spark):
    d, l = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality_model.score_quality(d, l).join(l, "doc_id").where("held_out").toPandas()
    rank = got.score.rank().to_numpy()
    good = (got.quality == 1).to_numpy()
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.95 and got[good].predicted.mean() > 0.97 and got[~good].predicted.mean() < 0.2


def learned(spark, seed, n, share):
    """Positives around one point; unlabelled rows of which ``share`` are such."""
    g = np.random.default_rng(seed)
    u = g.random(2 * n) < share
    x = np.vstack([g.normal(1, 1, (n, 3)), g.normal(0, 1, (2 * n, 3)) + np.where(u, 1, -2.5)[:, None]])
    return spark.createDataFrame([(v.tolist(), i < n) for i, v in enumerate(x)], "x array<float>, positive boolean").repartition(3), x.astype(np.float32).astype(float), np.arange(3 * n) < n


def test_fit_minimises_the_risk(spark):
    rows, x, positive = learned(spark, 3, 300, 0.4)
    model = quality_model.fit(rows, 0.5, steps=25)
    z = np.hstack([(x - x.mean(0)) / x.std(0), np.ones((len(x), 1))])
    decay = (quality_model.DECAY + quality_model.DECAY_OF_FEW / 300) * np.array([1, 1, 1, 0])

    def risk(w):
        g = z @ w
        negative = np.logaddexp(0, g).mean() - 0.5 * np.logaddexp(0, g[positive]).mean()
        return 0.5 * np.logaddexp(0, -g[positive]).mean() + max(0, negative) + (decay * w * w).sum() / 2

    w = np.append(model.weights, model.intercept)
    least = risk(w)
    g = np.random.default_rng(4)
    assert all(risk(w + g.normal(0, s, 4)) > least - 1e-6 for s in (0.003, 0.03, 0.3, 2) for _ in range(200))
    assert (np.logaddexp(0, z @ w).mean() - 0.5 * np.logaddexp(0, (z @ w)[positive]).mean()) >= 0


@pytest.mark.parametrize("share", [0.2, 0.6])
def test_prior_of_positives_and_unlabelled(spark, share):
    """The unlabelled rows hold the labelled ones, as texts do."""
    rows, _, positive = learned(spark, 5, 800, share)
    model = quality_model.fit(rows, 0.5)
    got = quality_model.class_prior(rows.select(model.column(F.col("x")).alias("g"), "positive"))
    true = (800 + 1600 * share) / 2400
    assert abs(got - true) < 0.06 and quality_model.class_prior(rows.where("NOT positive").select(F.lit(0.0).alias("g"), "positive")) == 0.5


def test_classifier_of_odd_rows(docs, none, labels, rows):
    got = quality_model.score_quality(docs, labels).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    assert quality_model.score_quality(none, labels).count() == 0
    assert quality_model.score_quality(docs, labels.limit(0)).where("score != 0.5").count() == 0


def test_stages_of_odd_rows(spark, docs, none, rows):
    """Rows without an id, and different rows under one, go by a stage's decision alone."""
    sf = "/root/testdata/sf0.001"
    same = lambda df: sorted(map(repr, df.select("doc_id", "text", "lang", "source").collect()))
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf).cache()
        assert out.columns == list(corpus_pipeline.COLUMNS) and stage(spark, none, sf).count() == 0
        if name == "quality_rules":
            assert out.where("doc_id IS NULL").count() == 1 and out.count() > 50
        if name == "ngram_jaccard":  # the first of every group stays, under whichever id, and all without words
            assert out.where("doc_id IS NULL").count() == 1 and out.where("text IS NULL").count() == 2
            assert out.where("text = 'one two'").count() == 1
        if name == "super_kmers":
            # two rows are one text under two ids; without ids, rows are later than all others
            assert out.where("text = 'one two'").count() == 3 and out.where("text IS NULL").count() == 0
            texts = {r.text for r in out.collect()}
            assert {t for _, t, *_ in rows[:100] if 0 < count(t) < 20} <= texts
        if name == "pareto_mixing":
            assert same(out.distinct().subtract(docs.select(*corpus_pipeline.COLUMNS))) == []
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.where("piece = 0").count() == len(rows) and packed.agg(F.sum("n_words")).first()[0] == sum(count(r[1]) for r in rows)
    assert corpus_pipeline.STAGES[-1][1](spark, none, sf).count() == 0


def test_junk_goes_in_every_language(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    base = quality_rules.judge(docs, labels).where("NOT base_failed").select("doc_id")
    from tideline.llm import queries

    kept = queries.op4_quality_rules(spark, sf).where("kept").select("doc_id", F.lit(1).alias("kept"))
    staged = corpus_pipeline.quality(spark, docs, sf).select("doc_id", F.lit(1).alias("kept"))
    assert kept.exceptAll(staged).count() == staged.exceptAll(kept).count() == 0
    got = base.join(docs, "doc_id").join(labels, "doc_id").join(kept, "doc_id", "left").groupBy("lang", "quality").agg(F.count("*").alias("n"), F.count("kept").alias("kept")).collect()
    print(sorted(map(tuple, got)))
    junk, clean = ({r.lang: r for r in got if r.quality == q} for q in (0, 1))
    assert len(junk) == 4 and all(r.kept < 0.2 * r.n for r in junk.values())
    assert all(r.kept >= 0.99 * r.n for r in clean.values())


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert [t for _, t in out.dtypes] == [t for _, t in docs.dtypes], name
        assert out.select("doc_id").distinct().join(docs, "doc_id", "left_anti").count() == 0
        docs = out.cache()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.where("piece = 0").count() == docs.count()
    whole = corpus_pipeline.run(spark, sf)
    assert whole.groupBy("doc_id").agg(F.sum("n_words").alias("w")).exceptAll(packed.groupBy("doc_id").agg(F.sum("n_words").alias("w"))).count() == 0
