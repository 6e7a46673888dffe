"""Near duplicates, repeated passages, token counts and rules against brute force."""

import re
from itertools import combinations

import numpy as np
import pytest
from compare import differences

from tideline.llm import bpe, near_text, quality_rules, queries, substring, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_windows_agree_with_words():
    g = np.random.default_rng(0)
    seq = g.integers(0, 3, 400).astype(np.uint64)
    for width in (1, 2, 5, 7, 20):
        codes = words.windows(words.mixed(seq), width)
        parts = [tuple(seq[i : i + width]) for i in range(len(seq) - width + 1)]
        assert len(codes) == len(parts) and len(set(codes.tolist())) == len(set(parts))
    assert len(words.windows(seq[:3], 5)) == 0
    assert words.split(None) == [] and words.split("A\u00a0É b", lower=True) == ["a\u00a0É".encode(), b"b"]


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_near_text(docs, rows):
    got = near_text.link_documents(docs).toPandas()
    assert len(got) == len(rows)
    sets = [(i, shingles(t)) for i, t, *_ in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, x), (b, y) in combinations(sets, 2):
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    sizes = {}
    for i, t, *_ in rows:
        sizes.setdefault(i, []).append(len(shingles(t)))
    for r in got.itertuples():
        if r.doc_id == r.doc_id:
            assert r.component_id == find(r.doc_id)
            assert r.n_shingles in sizes[r.doc_id]
        else:
            assert r.component_id != r.component_id


@pytest.mark.parametrize("large", [8, 64, 256])
def test_near_text_of_a_large_group(spark, monkeypatch, large):
    """Near copies of one text, some of them too far from any other, with a common passage elsewhere."""
    monkeypatch.setattr(near_text, "LARGE", large)
    monkeypatch.setattr(near_text, "BUCKET", 30)
    g = np.random.default_rng(3)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for k in range(150):
        w = list(base)
        for j in g.choice(120, g.integers(0, 7), replace=False):
            w[j] = f"e{k % 40}x{j}"
        rows.append((k, " ".join(w)))
    rows += [(200 + k, " ".join(base[20:80] + [f"u{k}y{i}" for i in range(25)])) for k in range(60)]
    got = {r.doc_id: r.component_id for r in near_text.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, x), (b, y) in combinations(sets, 2):
        if 100 * len(x & y) >= 80 * len(x | y):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    assert got == {i: find(i) for i in root}


def test_near_text_of_texts_with_words_added(spark):
    """Pairs of which one text is the other plus 5 to 24 % of words, in one place or three."""
    g = np.random.default_rng(11)
    rows = []
    for k in range(160):
        n = int(g.integers(60, 220))
        w = [f"p{k}w{i}" for i in range(n)]
        extra = [f"p{k}x{i}" for i in range(round(n * g.uniform(0.05, 0.24)))]
        at, more = sorted(g.integers(0, n + 1, 2).tolist()), np.array_split(extra, 3)
        longer = [w + extra, extra + w, [*w[: at[0]], *more[0], *w[at[0] : at[1]], *more[1], *w[at[1] :], *more[2]]][k % 3]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(longer))]
    got = {r.doc_id: r.component_id for r in near_text.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = dict((i, shingles(t)) for i, t in rows)
    alike = [k for k in range(0, 320, 2) if 100 * len(sets[k] & sets[k + 1]) >= 80 * len(sets[k] | sets[k + 1])]
    assert len(alike) > 100 and [k for k in alike if got[k + 1] != k] == []
    assert all(got[k + 1] == k + 1 for k in range(0, 320, 2) if k not in alike)


def test_substring(docs, rows):
    got = substring.remove_repeats(docs).toPandas()
    assert len(got) == len(rows)
    order = lambda r: (r[0] is None, r[0] or 0)
    first = {}
    for i, t, *_ in sorted(rows, key=order):
        w = WORD.findall(t or "")
        for k in range(len(w) - 19):
            first.setdefault(tuple(w[k : k + 20]), (i, k))
    want = []
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        gone = {j for k in range(len(w) - 19) if first[tuple(w[k : k + 20])] != (i, k) for j in range(k, k + 20)}
        want.append((i, None if t is None else " ".join(x for j, x in enumerate(w) if j not in gone), len(w), len(gone)))
    key = lambda r: tuple(repr(x) for x in r)
    have = [(None if r.doc_id != r.doc_id else int(r.doc_id), r.text, r.n_words, r.n_removed) for r in got.itertuples()]
    assert sorted(have, key=key) == sorted(want, key=key)


def test_substring_keeps_identical_rows_alike(spark):
    text = " ".join(f"a{i}" for i in range(30))
    got = substring.remove_repeats(spark.createDataFrame([(1, text), (1, text), (2, text + " b"), (3, (text + " ") * 3)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (1, 0), (2, 30), (3, 90)] or sorted((r.doc_id, r.n_removed) for r in got)[:3] == [(1, 0), (1, 0), (2, 30)]


def removed_by_brute_force(texts):
    """Texts left of (id, text) pairs with different ids."""
    first, out = {}, {}
    for i, t in sorted(texts):
        w = WORD.findall(t)
        for k in range(len(w) - 19):
            first.setdefault(tuple(w[k : k + 20]), (i, k))
    for i, t in texts:
        w = WORD.findall(t)
        gone = {j for k in range(len(w) - 19) if first[tuple(w[k : k + 20])] != (i, k) for j in range(k, k + 20)}
        out[i] = " ".join(x for j, x in enumerate(w) if j not in gone)
    return out


@pytest.mark.parametrize("hot", [5, 20_000])
def test_substring_of_hot_passages_and_stutter(spark, monkeypatch, hot):
    """One passage in a third of all texts, texts of few words that repeat, and copies; with codes counted as hot, and not."""
    monkeypatch.setattr(substring, "HOT", hot)
    g = np.random.default_rng(8)
    passage = [f"p{i}" for i in range(30)]
    texts = []
    for i in range(150):
        own = [f"w{x}" for x in g.integers(0, 3 if i % 7 == 0 else 400, int(g.integers(0, 120)))]
        at = int(g.integers(0, len(own) + 1))
        texts.append((i, " ".join(own[:at] + passage[: int(g.integers(15, 31))] + own[at:] if i % 3 == 0 else own)))
    texts += [(200 + i, " ".join(["a", "b"][: i % 2 + 1] * (11 + i))) for i in range(12)] + [(300 + i, texts[i * 9][1]) for i in range(12)]
    got = substring.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: r.text for r in got} == removed_by_brute_force(texts)


def test_layout_stays_where_nothing_goes(spark):
    a, b = "x\n\ny  z", "\n".join(f"a{i}" for i in range(25))
    got = substring.remove_repeats(spark.createDataFrame([(1, a), (2, b), (3, b + "  tail"), (4, None)], "doc_id long, text string"), layout=True).collect()
    assert {r.doc_id: r.text for r in got} == {1: a, 2: b, 3: "tail", 4: None}


def test_lowest_and_super_kmers():
    g = np.random.default_rng(1)
    x = g.integers(0, 1000, 300).astype(np.uint64)
    for width in (1, 2, 3, 17, 19):
        assert substring._lowest(x, width).tolist() == [x[i : i + width].min() for i in range(300 - width + 1)]
    sizes = np.array([0, 5, 19, 20, 21, 300, 0, 64, 3])
    codes = g.integers(0, 40, sizes.sum()).astype(np.uint64)
    of, first, n, code = substring.super_kmers(codes, sizes, 20)
    covered = sorted((o, f + i) for o, f, m in zip(of.tolist(), first.tolist(), n.tolist(), strict=True) for i in range(m))
    assert covered == [(o, k) for o, size in enumerate(sizes.tolist()) for k in range(size - 19)] and n.max() <= 20 - substring.SEQUENCE + 1
    assert len(substring.super_kmers(codes[:7], np.array([7]), 20)[0]) == 0 and len(code) == len(of)


def test_token_counts(docs, rows):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = tokenizers.Tokenizer.from_file(path)
    texts = [r[1] or "" for r in rows]
    want = sorted(zip([len(x.encode()) for x in texts], [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)], strict=True))
    assert sorted((r.n_bytes, r.n_tokens) for r in bpe.token_counts(docs, path).collect()) == want
    counts = bpe.Counts(bpe.load(path)[0])
    for word in (" hello", "hellooooooooooooo", "a" * 5000, "\n\n\n", "ß", " <|endof"):
        assert counts[word] == len(t.encode(word, add_special_tokens=False).ids)


def test_every_character(spark):
    """All characters that can be letters, numbers or spaces in any version, and some of the others, where classes matter."""
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x40000 or c % 97 == 0)]
    texts = [f"X'v{chr(c)}e X1{chr(c)}X 've {chr(c)}  {chr(c)}!" for c in points]
    got = bpe.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).toPandas().sort_values("doc_id").n_tokens
    want = [len(e.ids) for e in tokenizers.Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [hex(points[i]) for i in np.flatnonzero(got.to_numpy() != np.array(want))] == []


def test_special_strings(spark):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x<|endoftext|"]
    got = bpe.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got] == [len(e.ids) for e in tokenizers.Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_rule_counts(docs, labels, rows):
    got = quality_rules.judge(docs, labels).toPandas()
    assert len(got) == len(rows)

    def brute(t):
        w = WORD.findall(t or "")
        seen, cover = {}, set()
        for k in range(len(w) - 7):
            seen.setdefault(tuple(w[k : k + 8]), []).append(k)
        for ks in seen.values():
            if len(ks) > 1:
                cover.update(j for k in ks for j in range(k, k + 8))
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        n = len(w)
        return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(cover), n < 20 or 100 * len(cover) > 30 * n

    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert sorted(map(tuple, got[columns].values.tolist())) == sorted(brute(r[1]) for r in rows)
    assert not (got.kept & got.base_failed).any()


def test_most_losses(spark):
    from math import comb

    from pyspark.sql import functions as F

    for n, a, level in ((0, 0.01, 0.01), (100, 0.05, 0.05), (900, 0.01, 0.02), (3000, 0.0033, 0.004)):
        cdf, want = 0.0, -1
        for k in range(n + 1):
            cdf += comb(n, k) * a**k * (1 - a) ** (n - k)
            if cdf > level:
                break
            want = k
        assert spark.range(1).select(quality_rules.most_losses(F.lit(n).cast("long"), a, F.lit(level))).first()[0] == want


def test_promise_holds_on_resampled_labels(spark):
    """Forty strata are samples of one population whose losses are known: no certified cutoff loses more than was promised."""
    import numpy as np
    from pyspark.sql import functions as F

    g = np.random.default_rng(44)
    risk = np.minimum(g.exponential(0.05, 20_000), 1)
    rows = []
    for k in range(40):
        own = g.choice(risk, 420)
        rows += [(k * 1000 + i, f"s{k}", False, float(r) ** 3, 0.0, 0.0) for i, r in enumerate(own)]
        rows += [(k * 1000 + 500 + i, f"s{k}", False, float(r) ** 3, 0.0, 0.0) for i, r in enumerate(g.uniform(0.1, 1, 60))]
    measured = spark.createDataFrame(rows, "id long, stratum string, base_failed boolean, noise double, repeats double, dup_lines double")
    labels = measured.select(F.col("id").alias("doc_id"), (F.col("id") % 1000 < 500).cast("int").alias("quality"))
    got = quality_rules.certify(measured, labels, "doc_id").collect()
    own = [r for r in got if not r.pooled]
    assert len(own) == 40 and all((risk > r.cutoff).mean() <= quality_rules.ALPHA for r in own)
    assert all(r.cutoff < 0.6 for r in own)  # and they are of use


def test_strata_with_few_labels_take_a_pool(spark):
    from pyspark.sql import functions as F

    def certified(sizes):
        rows = [(s * 10_000 + i, None if s == 1 else f"s{s}", False, 0.125 if i % 10 == 0 else 0.0, 0.0, 0.0) for s, n in enumerate(sizes) for i in range(n)]
        measured = spark.createDataFrame(rows, "id long, stratum string, base_failed boolean, noise double, repeats double, dup_lines double")
        labels = measured.select(F.col("id").alias("doc_id"), (F.col("id") % 10 != 0).cast("int").alias("quality"))
        return sorted((r.pooled, repr(r.stratum), r.cutoff) for r in quality_rules.certify(measured, labels, "doc_id").collect())

    # junk has the risk 0.5: the loosest cutoff below it
    assert certified([400, 400]) == [(False, "'s0'", 0.48), (False, "None", 0.48), (True, "None", 0.48)]  # the pool is for strata without any label
    assert certified([400, 50, 50]) == [(False, "'s0'", 0.48), (True, "None", 0.48)]  # the pool of all
    assert certified([400, 150, 150]) == [(False, "'s0'", 0.48), (True, "None", 0.48)]  # the pool of the other two
    assert certified([100, 60]) == [] and certified([]) == []
    assert certified([150, 150]) == [(True, "None", 0.48)]


def test_cutoffs_keep_their_promise(spark):
    """Clean texts with few symbols, junk with many: the cutoff rejects the junk and next to nothing that is clean."""
    from pyspark.sql import functions as F

    clean = " ".join(f"word{i}" for i in range(40))
    d = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit(clean), F.repeat(F.lit(" #"), F.when(F.col("id") % 3 == 0, 200).otherwise(F.col("id") % 2).cast("int"))).alias("text"), F.lit("en").alias("lang"))
    l = spark.range(6000).select(F.col("id").alias("doc_id"), (F.col("id") % 3 != 0).cast("int").alias("quality"))
    got = quality_rules.judge(d, l).groupBy((F.col("doc_id") % 3 == 0).alias("junk")).agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()
    assert {r.junk: r.kept for r in got} == {True: 0.0, False: 1.0}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, "/root/testdata/sf0.01"), queries.SQL[name], "/root/testdata/sf0.01") == []


def test_empty_tables(none, labels):
    import public_tokenizers

    assert near_text.link_documents(none).count() == 0
    assert substring.remove_repeats(none).count() == 0
    assert bpe.token_counts(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert quality_rules.judge(none, labels).count() == 0
    assert quality_rules.judge(none, labels.limit(0)).count() == 0
