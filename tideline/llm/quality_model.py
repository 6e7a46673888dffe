"""A quality classifier learned from trusted positives and unlabelled text.

With logistic loss l(g) = ln(1 + exp(-g)), the non-negative unbiased risk (Kiryo et
al., 2017) of a classifier g is p E+[l(g)] + max(0, Eu[l(-g)] - p E+[l(-g)]), where
E+ is over trusted positives, Eu over unlabelled text and p is the share of
positives among the latter. The second part estimates the risk on negatives. While
it is positive, the risk equals -p E+[g] + Eu[l(-g)], which is convex: it is
minimised by Newton's method, and a step that would take the second part below
zero, or not lower the risk, is halved. Sigmoid(g) is the probability of a positive.

All positives and all unlabelled texts are used: every step is one aggregate over
the written features, and the driver sees sums only.

The class prior p is estimated from positives and unlabelled texts alone, by a
first classifier on texts it was not fitted on: among the texts that score at
least t, the share of unlabelled over the share of positives is p plus what
negatives score so high, so its minimum over t estimates p (Scott, 2015).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written
from .words import codes_of, mixed, split, windows

FOLDS, STEPS = 5, 15
#: Weight decay: the sum of the first and of the second over the number of positives.
DECAY, DECAY_OF_FEW = 1e-3, 10.0
#: The fold on which the prior is estimated, and the share of positives that a threshold must keep for that.
PRIOR_FOLD, LEAST_SHARE = 1, 0.5
#: Buckets of hashed character trigrams and of hashed word pairs.
TRIGRAMS = PAIRS = 32

SHARES = ("length", "symbols", "marks", "upper", "digits", "stops", "word_length", "distinct", "top", "stutter", "lines", "line_words")
SIZE = len(SHARES) + TRIGRAMS + PAIRS
_SYMBOLS, _UPPER, _DIGITS, _STOPS = b"#*$%&|<>~^=_\\{}[]@+", bytes(range(65, 91)), b"0123456789", b".,;:"


def _hashed(codes: np.ndarray, buckets: int) -> np.ndarray:
    """Roots of the shares of ``codes`` that fall in each bucket."""
    return np.sqrt(np.bincount((codes >> np.uint64(40)).astype(np.int64) % buckets, minlength=buckets) / max(1, len(codes)))


def features(text: str | None) -> np.ndarray:
    """What describes a whole text: shares and logarithms, and hashed trigrams of bytes and pairs of words; of an empty one, all are 0."""
    words = split(text)
    if not words:
        return np.zeros(SIZE)
    raw = b"".join(words)
    n, chars = len(words), len(raw)
    share = lambda drop: (chars - len(raw.translate(None, drop))) / chars
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()] or [text]
    byte = np.frombuffer(b" ".join(words).lower(), np.uint8).astype(np.uint64)
    trigrams = mixed((byte[:-2] << np.uint64(16)) + (byte[1:-1] << np.uint64(8)) + byte[2:]) if len(byte) > 2 else byte[:0]
    shares = [
        np.log1p(n),
        share(_SYMBOLS) ** 0.5,
        share(b"!?") ** 0.5,
        share(_UPPER) ** 0.5,
        share(_DIGITS) ** 0.5,
        share(_STOPS) ** 0.5,
        np.log(chars / n),
        np.log(len(counts) / n),
        (max(counts.values()) / n) ** 0.5,
        (sum(map(eq, words, words[1:])) / n) ** 0.5,
        (1 - len(set(lines)) / len(lines)) ** 0.5,
        np.log(n / len(lines)),
    ]
    return np.concatenate([shares, _hashed(trigrams, TRIGRAMS), _hashed(windows(codes_of(words), 2), PAIRS)])


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.array([features(t) for t in batch.column("text").to_pylist()], np.float32).reshape(batch.num_rows, SIZE)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * SIZE), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("id"), lists], ["id", "x"])


@dataclass(frozen=True)
class Model:
    """g = weights . (x - centre) / spread + intercept"""

    weights: np.ndarray
    intercept: float
    centre: np.ndarray
    spread: np.ndarray

    def column(self, x: Column) -> Column:
        slopes = self.weights / self.spread
        g = F.lit(float(self.intercept - slopes @ self.centre))
        for i, w in enumerate(slopes.tolist()):
            g = g + F.lit(w) * x[i].cast("double")
        return F.least(F.greatest(g, F.lit(-60.0)), F.lit(60.0))


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1), batch.column("positive").to_numpy(zero_copy_only=False)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        x, positive = _rows(batch)
        part = np.concatenate([[len(x), positive.sum()], x.sum(axis=0), (x * x).sum(axis=0)])
        total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total])], ["sums"])


def _step_sums(batches: Iterator[pa.RecordBatch], w: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums at w: of l(-g) over all rows, of l(-g) and g over the positives, of the positives' inputs, of the slopes and of the curvatures."""
    total, upper = 0.0, np.triu_indices(len(w))
    for batch in batches:
        x, positive = _rows(batch)
        z = np.hstack([(x - centre) / spread, np.ones((len(x), 1))])
        g = z @ w
        loss, s = np.logaddexp(0, g), 1 / (1 + np.exp(-np.clip(g, -60, 60)))
        curve = (z.T * (s * (1 - s))) @ z
        total = total + np.concatenate([[loss.sum(), loss[positive].sum(), g[positive].sum()], z[positive].sum(axis=0), z.T @ s, curve[upper]])
    if not np.isscalar(total):
        yield pa.RecordBatch.from_arrays([pa.array([total])], ["sums"])


def _summed(parts: DataFrame) -> np.ndarray:
    """The sum of the arrays of all tasks, added up by position before it comes to the driver."""
    rows = parts.select(F.posexplode("sums").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect()
    return np.array([r.v for r in sorted(rows, key=lambda r: r.k)])


def fit(rows: DataFrame, prior: float, steps: int = STEPS) -> Model | None:
    """The minimiser of the non-negative risk over ``rows`` (x, positive): unlabelled texts are all of them; None without positives."""
    rows = rows.select("x", "positive")
    sums = _summed(rows.mapInArrow(_moments, "sums array<double>"))
    if not len(sums) or not sums[1]:
        return None
    n, positives = sums[:2]
    size = (len(sums) - 2) // 2
    centre = sums[2 : 2 + size] / n
    spread = np.sqrt(np.maximum(sums[2 + size :] / n - centre**2, 0))
    spread = np.where(spread < 1e-6, 1.0, spread)
    upper, decay = np.triu_indices(size + 1), (DECAY + DECAY_OF_FEW / positives) * np.append(np.ones(size), 0)
    w = np.append(np.zeros(size), np.log(prior / (1 - prior)))
    best, move, share = None, None, 1.0
    for _ in range(steps):
        tried = w if best is None else w - share * move
        sums = _summed(rows.mapInArrow(partial(_step_sums, w=tried, centre=centre, spread=spread), "sums array<double>"))
        risk = sums[0] / n - prior * sums[2] / positives + (decay * tried**2).sum() / 2
        negative = sums[0] / n - prior * sums[1] / positives
        if best is not None and (risk > best or negative < 0):
            share /= 2
            if share < 1 / 64:
                break
            continue
        done = best is not None and best - risk < 1e-7
        w, best, share = tried, risk, 1.0
        if done:
            break
        slope = sums[4 + size : 5 + 2 * size] / n - prior * sums[3 : 4 + size] / positives + decay * w
        curve = np.zeros((size + 1, size + 1))
        curve[upper] = sums[5 + 2 * size :] / n
        curve = curve + np.triu(curve, 1).T + np.diag(decay + 1e-9)
        move = np.linalg.solve(curve, slope)
    return Model(w[:-1], float(w[-1]), centre, spread)


def class_prior(scored: DataFrame) -> float:
    """The share of positives among all rows of (g, positive), within 0.01 and 0.99; a half without positives."""
    bins = scored.groupBy(F.floor(F.col("g") * 20).alias("bin")).agg(F.count("*").alias("n"), F.count_if("positive").alias("p")).orderBy(F.desc("bin")).collect()
    n, p = (np.cumsum([r[k] for r in bins], dtype=float) for k in ("n", "p"))
    if not len(p) or not p[-1]:
        return 0.5
    kept = p / p[-1] >= LEAST_SHARE
    return float(np.clip(((n / n[-1]) / np.maximum(p / p[-1], 1e-9))[kept].min(), 0.01, 0.99))


def fold(id_: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % FOLDS


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(id, held_out, score, predicted) of every row.

    Labels are read of rows whose fold is not 0, and of these the positives only.
    The unlabelled texts are all texts of the same folds. Scores use the text
    alone. Null labels and null ids are not learned from; an id with labels of
    both kinds is no positive. Empty and null texts get a score too. Without
    positives or texts to learn from, every score is a half.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    featured = written(rows.mapInArrow(_featured, f"id {kind}, x array<float>"), "features")
    known = labels.select(F.col(id_col).alias("id"), "quality").where(F.col("id").isNotNull() & F.col("quality").isNotNull() & (fold(F.col("id")) != 0))
    trusted = known.groupBy("id").agg(F.min("quality").alias("quality")).where("quality = 1").select("id", F.lit(True).alias("positive"))
    usable = featured.where(F.col("id").isNotNull() & (fold(F.col("id")) != 0)).join(trusted, "id", "left")
    usable = written(usable.select(fold(F.col("id")).cast("int").alias("fold"), "x", F.coalesce("positive", F.lit(False)).alias("positive")), "learned")
    first = fit(usable.where(F.col("fold") != PRIOR_FOLD), 0.5)
    prior = class_prior(usable.where(F.col("fold") == PRIOR_FOLD).select(first.column(F.col("x")).alias("g"), "positive")) if first else 0.5
    model = fit(usable, prior)
    g = model.column(F.col("x")) if model else F.lit(0.0)
    return featured.select(F.col("id").alias(id_col), (fold(F.col("id")) == 0).alias("held_out"), (1 / (1 + F.exp(-g))).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
