"""DuckDB SQL for the queries of operators whose results it can state directly, pair by pair."""

from __future__ import annotations

WORDS = r"'[^\x20\x09-\x0D]+'"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_REACH = """e AS (SELECT x AS a, y AS b FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT id, id AS root FROM nodes UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id WHERE r.root < e.b),
c AS (SELECT id, min(root) AS root FROM r GROUP BY id)"""

NGRAM_JACCARD = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), {WORDS}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
nodes AS (SELECT doc_id AS id FROM n), {_REACH}
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.root, w.doc_id) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.id = w.doc_id
"""

SUPER_KMERS = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) AS words FROM documents),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 19], ' ') AS g FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 19)) AS i FROM w WHERE len(words) >= 20)),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS k FROM d, generate_series(0, 19) AS t(j)),
pos AS (SELECT doc_id, unnest(words) AS word, unnest(generate_series(1, len(words))) AS k FROM w WHERE len(words) > 0),
kept AS (SELECT pos.doc_id, string_agg(word, ' ' ORDER BY pos.k) FILTER (WHERE gone.k IS NULL) AS t, count(gone.k) AS n FROM pos LEFT JOIN gone ON gone.doc_id = pos.doc_id AND gone.k = pos.k GROUP BY pos.doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""

PIVOT_INDEX = rf"""
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
g AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = len(e) AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM g a JOIN g b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
nodes AS (SELECT vec_id AS id FROM embeddings), {_REACH},
n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.root AS component_id, c.root = vec_id AS kept FROM embeddings LEFT JOIN n ON n.a = vec_id JOIN c ON c.id = vec_id
"""


def _shares(table: str, by: str, order: str, total: str, weight: str, cap: str, name: str) -> str:
    """SQL of ``mixing.capped_shares``: rows of ``table`` and their share of ``total``."""
    part = f"PARTITION BY {by} " if by else ""
    before = f"OVER ({part}ORDER BY r, {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    whole = f"OVER ({part.strip()})"
    return f"""SELECT * EXCLUDE (t_, w_, c_, r, used, gone, all_, lev, level), CASE WHEN level IS NULL OR r <= level THEN c_ ELSE w_ * level END AS {name} FROM (
  SELECT *, first_value(CASE WHEN r > lev THEN lev END IGNORE NULLS) OVER ({part}ORDER BY r, {order} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS level FROM (
    SELECT *, (t_ - used) / (all_ - gone) AS lev FROM (
      SELECT *, coalesce(sum(c_) {before}, 0) AS used, coalesce(sum(w_) {before}, 0) AS gone, sum(w_) {whole} AS all_ FROM (
        SELECT *, c_ / w_ AS r FROM (SELECT *, ({total})::DOUBLE AS t_, ({weight})::DOUBLE AS w_, ({cap})::DOUBLE AS c_ FROM {table})))))"""


PARETO_MIXING = rf"""
WITH sizes AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {WORDS}))::BIGINT AS size FROM documents),
src AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source)),
tgt AS ({_shares("src", "", "source", "(SELECT sum(source_size) FROM src)", "weight", "source_size * 3", "target")}),
cls0 AS (SELECT s.source, length(bin(size)) - 1 AS class, sum(size)::BIGINT AS words, any_value(target) AS target FROM sizes s JOIN tgt ON tgt.source IS NOT DISTINCT FROM s.source WHERE size > 0 GROUP BY 1, 2),
cls1 AS ({_shares("cls0", "source", "class", "target", "words * pow(2.0, -0.125 * class)", "words * 3", "part")}),
cls AS (SELECT *, floor(round(part / words, 9))::BIGINT AS whole, round(part / words, 9) - floor(round(part / words, 9)) AS odd FROM cls1),
lft AS (SELECT *, target - sum(whole * words) OVER (PARTITION BY source) AS left_ FROM cls),
u AS (SELECT s.doc_id, s.source, s.size, whole, odd, left_, (('0x' || substr(md5(coalesce(s.doc_id::VARCHAR, 'null') || ':17'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496 AS u
  FROM sizes s LEFT JOIN lft ON lft.source IS NOT DISTINCT FROM s.source AND s.size > 0 AND lft.class = length(bin(s.size)) - 1),
o AS (SELECT *, CASE WHEN odd > 0 THEN (u / (1 - u)) / (odd / (1 - odd)) END AS q FROM u),
k AS (SELECT *, floor(q / (1 + q) * 1099511627776)::BIGINT AS rank FROM o),
x AS (SELECT *, CASE WHEN rank IS NOT NULL AND sum(CASE WHEN rank IS NOT NULL THEN size END) OVER (PARTITION BY source, rank IS NULL ORDER BY rank, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= left_ THEN 1 ELSE 0 END AS extra FROM k),
g AS (SELECT source, max(left_) - sum(extra * size) AS missing FROM x GROUP BY source),
f AS (SELECT source, doc_id, size FROM (SELECT x.source, doc_id, size, row_number() OVER (PARTITION BY x.source ORDER BY abs(missing - size), size, coalesce(rank, -1), doc_id) AS n FROM x JOIN g ON g.source IS NOT DISTINCT FROM x.source
  WHERE extra = 0 AND size > 0 AND whole < 3 AND abs(missing - size) < missing) WHERE n = 1)
SELECT x.doc_id, x.size, source_size, target, ((coalesce(whole, 0) + extra + CASE WHEN f.doc_id IS NOT NULL AND extra = 0 THEN 1 ELSE 0 END) * x.size)::BIGINT AS taken
FROM x JOIN tgt ON tgt.source IS NOT DISTINCT FROM x.source LEFT JOIN f ON f.source IS NOT DISTINCT FROM x.source AND f.doc_id = x.doc_id AND f.size = x.size
"""
