"""URL filtering by rules first, and by empirical-Bayes host reputation where no rule fits.

Labelled page outcomes are counted by host. The rate of a suffix is shrunk to the
rate of all pages, that of a registered domain to its suffix, and that of a host
to its domain, each through a beta prior whose strength is estimated from how
much the rates at that level differ beyond chance. A host is blocked only if its
posterior is low beyond doubt: the upper quantile of the beta distribution must be
under the threshold, which is to say that next to nothing of it lies above.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import written

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Suffixes of two labels under which names are registered; a parameter, as the full public list changes.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "or.jp", "ne.jp", "co.nz", "com.br", "com.cn", "co.in", "co.za", "com.mx", "com.tr")
#: A host is blocked if less than DOUBT of its posterior is at THRESHOLD and above: its (1 - DOUBT) quantile is below.
THRESHOLD, DOUBT = 0.5, 0.05
#: Limits of a prior's strength, in pages.
WEAKEST, STRONGEST = 1.0, 1000.0

Rule = tuple[str, str, str]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty where the url is null or has no ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return F.translate(part(1), UPPER, UPPER.lower()), part(2)


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits (as text) and its action; null where none does. Rules are (action, host, path)."""
    name = action = None
    for act, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p).otherwise(F.lit(None) if name is None else name)
        action = F.when(fits, act).otherwise(F.lit(None) if action is None else action)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, action)


def registered_domain(host: Column, suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> tuple[Column, Column]:
    """The registered domain of a host and its suffix; a bare suffix stands for itself."""
    two = F.substring_index(host, ".", -2)
    long = two.isin(*suffixes)
    return F.when(long, F.substring_index(host, ".", -3)).otherwise(two), F.when(long, two).otherwise(F.substring_index(host, ".", -1))


def read_suffixes(spark: SparkSession, path: str) -> tuple[str, ...]:
    """The suffixes of two labels in a file of the public list's form: one a line, comments after ``//``, no wildcards."""
    lines = spark.read.text(path).where(r"value RLIKE '^[^/!*.\\s]+\\.[^/.\\s]+\\s*$'").select(F.lower(F.trim("value")).alias("s")).distinct()
    return tuple(sorted(r.s for r in lines.collect()))


def log_gamma(z: Column) -> Column:
    """By Stirling's series at z + 8, and back in eight steps; to about 1e-11 for positive z."""
    w = z + 8
    steps = F.lit(1.0)
    for i in range(8):
        steps = steps * (z + i)
    series = 1 / (12 * w) - 1 / (360 * w * w * w) + 1 / (1260 * w * w * w * w * w) - 1 / (1680 * w * w * w * w * w * w * w)
    return (w - 0.5) * F.log(w) - w + F.lit(0.5 * math.log(2 * math.pi)) + series - F.log(steps)


def upper_tail(a: Column, b: Column, t: float) -> Column:
    """P(x >= t) of a beta distribution whose mean is below ``t``, by the series of the incomplete beta function.

    The terms fall from the first on, and after some multiple of sqrt(a + b) of
    them the rest is below what a double holds.
    """
    terms = F.sequence(F.lit(1), (60 + 12 * F.sqrt(a + b)).cast("int"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(s: Column, n: Column) -> Column:
        term = s["term"] * (a + b + n - 1) / (b + n) * (1 - t)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    scale = F.exp(b * math.log(1 - t) + a * math.log(t) + log_gamma(a + b) - log_gamma(a) - log_gamma(b) - F.log(b))
    return scale * F.aggregate(terms, start, step, lambda s: s["sum"])


def _strength(groups: DataFrame) -> DataFrame:
    """One row: the prior strength 1 / rho - 1, with rho from the analysis of variance of the groups' rates."""
    rate = F.col("k") / F.col("n")
    sums = groups.where("n > 0").agg(
        F.sum("n").cast("double").alias("N"),
        F.sum("k").cast("double").alias("K"),
        F.count("*").cast("double").alias("G"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("NN"),
        F.sum(F.col("k") * rate).alias("KR"),
    )
    rho = """CASE WHEN G > 1 AND N > G THEN
        ((KR - K * K / N) / (G - 1) - (K - KR) / (N - G)) / nullif((KR - K * K / N) / (G - 1) + ((N - NN / N) / (G - 1) - 1) * (K - KR) / (N - G), 0) END"""
    return sums.select(F.expr(f"CASE WHEN ({rho}) > 0 THEN greatest({WEAKEST}D, least({STRONGEST}D, 1 / ({rho}) - 1)) ELSE {STRONGEST}D END").alias("m"))


def reputation(outcomes: DataFrame, threshold: float = THRESHOLD, doubt: float = DOUBT, suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """(host, good, doubt, bad) of every host of ``outcomes`` (host, good boolean or null: not labelled); ``doubt`` is the posterior at the threshold and above."""
    domain, suffix = registered_domain(F.col("host"), suffixes)
    counts = outcomes.groupBy("host").agg(F.count("good").alias("n"), F.sum(F.when(F.col("good"), 1).otherwise(0)).alias("k"))
    hosts = written(counts.withColumns({"domain": domain, "suffix": suffix}), "hosts")
    of = lambda c: hosts.groupBy(c).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = hosts.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("k"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    m = {name: _strength(g).first().m for name, g in (("suffix", of("suffix")), ("domain", of("domain")), ("host", hosts))}
    mean = lambda prior, level: (F.col("k") + F.lit(m[level]) * prior) / (F.col("n") + m[level])
    suffixes = of("suffix").select("suffix", mean(F.lit((total.k + 1) / (total.n + 2)), "suffix").alias("suffix_rate"))
    pairs = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    domains = pairs.join(suffixes, "suffix").select("domain", "suffix", mean(F.col("suffix_rate"), "domain").alias("domain_rate"))
    a = F.col("k") + F.lit(m["host"]) * F.col("domain_rate")
    b = F.col("n") - F.col("k") + F.lit(m["host"]) * (1 - F.col("domain_rate"))
    posterior = hosts.join(domains, ["domain", "suffix"]).select("host", a.alias("a"), b.alias("b"))
    good = F.col("a") / (F.col("a") + F.col("b"))
    above = F.when(good < threshold, upper_tail(F.col("a"), F.col("b"), threshold)).otherwise(F.lit(1.0))
    return posterior.select("host", good.alias("good"), above.alias("doubt")).withColumn("bad", F.col("doubt") < doubt)


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", threshold: float = THRESHOLD, doubt: float = DOUBT, suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """(id, host, path, rule, verdict) of every page.

    ``outcomes`` has (id, good boolean) of the labelled pages; where an id is
    labelled more than once, all its labels must be good. Null urls and urls without ``://`` have an empty host and path; they share the
    reputation of the empty host. Null ids keep their rows and count as not
    labelled; every repeated row counts. Other columns are not read.
    """
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    known = outcomes.where("id IS NOT NULL AND good IS NOT NULL").groupBy("id").agg(F.min("good").alias("good"))
    hosts = written(reputation(rows.select("id", "host").join(known, "id", "left").select("host", "good"), threshold, doubt, suffixes), "reputation")
    rule, action = fitting_rule(F.col("host"), F.col("path"), rules)
    bad = hosts.where("bad").select("host", "bad")
    verdict = F.coalesce(action, F.when(F.col("bad"), "block").otherwise("allow"))
    return rows.join(bad, "host", "left").select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def page_number(url: Column) -> Column:
    """The number in the last part of a url's path, which names the page's document."""
    return F.regexp_extract(F.coalesce(split_url(url)[1], F.lit("")), r"/([0-9]{1,18})[^/]*/?$", 1).try_cast("long")


def _sql(rules: Sequence[Rule]) -> str:
    longest = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = [f"WHEN (p.host = '{h}' OR ends_with(p.host, '.{h}')) AND starts_with(path, '{p}') THEN" for _, h, p in longest]
    rule = "CASE " + " ".join(f"{f} '{h}{p}'" for f, (_, h, p) in zip(fits, longest, strict=True)) + " END"
    action = "CASE " + " ".join(f"{f} '{a}'" for f, (a, _, _) in zip(fits, longest, strict=True)) + " END"
    two = ", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES)
    last = lambda k: f"array_to_string(string_split(host, '.')[-{k}:], '.')"
    strength = lambda t: f"""SELECT CASE WHEN rho > 0 THEN greatest({WEAKEST}, least({STRONGEST}, 1 / rho - 1)) ELSE {STRONGEST} END AS m FROM (
        SELECT CASE WHEN G > 1 AND N > G THEN ((KR - K * K / N) / (G - 1) - (K - KR) / (N - G)) / nullif((KR - K * K / N) / (G - 1) + ((N - NN / N) / (G - 1) - 1) * (K - KR) / (N - G), 0) END AS rho
        FROM (SELECT sum(n)::DOUBLE AS N, sum(k)::DOUBLE AS K, count(*)::DOUBLE AS G, sum(n::DOUBLE * n) AS NN, sum(k * (k::DOUBLE / n)) AS KR FROM {t} WHERE n > 0))"""  # noqa: E731
    return rf"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{UPPER}', '{UPPER.lower()}') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
lab AS (SELECT doc_id, min((quality = 1 AND toxic = 0)::INT) AS good FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY doc_id),
h AS (SELECT host, count(good) AS n, coalesce(sum(good), 0) AS k,
        CASE WHEN {last(2)} IN ({two}) THEN {last(3)} ELSE {last(2)} END AS domain,
        CASE WHEN {last(2)} IN ({two}) THEN {last(2)} ELSE {last(1)} END AS suffix
      FROM p LEFT JOIN lab ON lab.doc_id = try_cast(regexp_extract(path, '/([0-9]{{1,18}})[^/]*/?$', 1) AS BIGINT) GROUP BY host),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY suffix),
d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY domain, suffix),
d1 AS (SELECT domain, sum(n) AS n, sum(k) AS k FROM h GROUP BY domain),
ms AS ({strength("s")}), md AS ({strength("d1")}), mh AS ({strength("h")}),
t AS (SELECT (coalesce(sum(k), 0) + 1)::DOUBLE / (coalesce(sum(n), 0) + 2) AS rate FROM h),
sr AS (SELECT suffix, (k + ms.m * t.rate) / (n + ms.m) AS rate FROM s, ms, t),
dr AS (SELECT domain, d.suffix, (k + md.m * sr.rate) / (n + md.m) AS rate FROM d JOIN sr ON sr.suffix = d.suffix, md),
ab AS (SELECT host, k + mh.m * dr.rate AS a, n - k + mh.m * (1 - dr.rate) AS b FROM h JOIN dr ON dr.domain = h.domain AND dr.suffix = h.suffix, mh),
bad AS (SELECT host FROM ab WHERE a / (a + b) < {THRESHOLD} AND exp(b * ln(1 - {THRESHOLD}) + a * ln({THRESHOLD}) + lgamma(a + b) - lgamma(a) - lgamma(b) - ln(b))
  * list_sum(list_transform(range(0, CAST(60 + 12 * sqrt(a + b) AS BIGINT)), lambda n: exp(lgamma(a + b + n) - lgamma(a + b) - lgamma(b + 1 + n) + lgamma(b + 1) + n * ln(1 - {THRESHOLD})))) < {DOUBT})
SELECT page_id, p.host, path, {rule} AS rule,
  coalesce({action}, CASE WHEN bad.host IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM p LEFT JOIN bad ON bad.host = p.host
"""


#: The rules of the registered query.
RULES: tuple[Rule, ...] = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
SQL = _sql(RULES)
