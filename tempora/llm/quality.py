"""Operator 9, quality classifier: regularised quadratic discriminant over transformed document statistics.

Each whole text gives a vector of statistics (character classes, word and line shape, repetition), square-rooted or
logged. Class means and covariances come from sums over every labelled training row, so nothing is sampled; each
covariance is shrunk towards the pooled one and towards a multiple of the identity. The score is the logistic of the
difference of log densities, whose Mahalanobis terms use the Cholesky factors kept in the model.

Nulls and odd rows: a null text is an empty one and gets a score; label rows with a null id or class are ignored;
repeated label rows count each; with no training rows of one class the score is the other class's (0.5 if there are
none at all); rows with a null doc_id are scored, never trained on; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm.common import as_bytes, load, materialize, tidy, whole_texts

FOLDS = 5
THRESHOLD = 0.3

_CLASSES = {
    "lower": bytes(range(97, 123)),
    "upper": bytes(range(65, 91)),
    "digit": b"0123456789",
    "space": b" \t\n\r\x0b\x0c",
    "stop": b".,;:?",
    "shout": b"!",
    "pipe": b"|",
    "symbol": b"#$%&*+/<=>@[\\]^_`{}~",
    "quote": b"\"'()-",
    "wide": bytes(range(0xC0, 0x100)),  # the first byte of every other character
}
_NAMES = list(_CLASSES)
_MEMBER = np.zeros((256, len(_CLASSES)))
for _i, _c in enumerate(_CLASSES.values()):
    _MEMBER[list(_c), _i] = 1.0
_SPACE = np.zeros(256, bool)
_SPACE[list(_CLASSES["space"])] = True

#: Short texts are drawn to the usual shares as if so many more characters and words of usual prose stood beside them.
CHARS, WORDS = 300.0, 50.0

STATISTICS = ("upper", "digit", "stop", "shout", "pipe", "symbol", "quote", "wide", "word_length", "short_words", "long_words", "distinct_words", "line_words", "distinct_lines", "repeated_words")


def statistics_of(texts: list[bytes]) -> np.ndarray:
    """(n, len(STATISTICS)) transformed statistics; an empty text has those of usual prose."""
    counts = np.zeros((len(texts), 256))
    shape = np.zeros((len(texts), 8))
    for i, text in enumerate(texts):
        if not text:
            continue
        raw = np.frombuffer(text, np.uint8)
        counts[i] = np.bincount(raw, minlength=256)
        gaps = np.diff(np.concatenate(([-1], np.flatnonzero(_SPACE[raw]), [len(raw)]))) - 1
        lengths = gaps[gaps > 0]
        words, lines = text.split(), text.split(b"\n")
        n = len(lengths)
        shape[i] = (n, lengths.sum(), (lengths <= 3).sum(), (lengths >= 14).sum(), len(set(words)), len(lines), len(set(lines)), sum(map(eq, words, islice(words, 1, None))))
    kinds = counts @ _MEMBER
    of = {k: kinds[:, j] for j, k in enumerate(_NAMES)}
    chars = of["lower"] + of["upper"] + of["digit"] + of["space"] + of["stop"] + of["shout"] + of["pipe"] + of["symbol"] + of["quote"] + of["wide"]
    letters = of["lower"] + of["upper"] + of["wide"]
    n, total, short, long_, distinct, lines, distinct_lines, twice = shape.T

    def share(part, whole, usual, weight):
        """Square root of a share, drawn to the usual one in short texts, whose shares say little."""
        return np.sqrt((part + usual * weight) / (whole + weight))

    new = np.log1p(distinct + WORDS) / np.log1p(n + WORDS)
    return np.column_stack([
        share(of["upper"], letters, 0.03, CHARS), share(of["digit"], chars, 0.001, CHARS), share(of["stop"], n, 0.15, WORDS), share(of["shout"], chars, 0.001, CHARS), share(of["pipe"], chars, 0.001, CHARS),
        share(of["symbol"], chars, 0.001, CHARS), share(of["quote"], chars, 0.002, CHARS), share(of["wide"], chars, 0.02, CHARS), np.log1p((total + 5.5 * WORDS) / (n + WORDS)), share(short, n, 0.35, WORDS), share(long_, n, 0.03, WORDS),
        new, np.log1p((n + WORDS) / (lines + WORDS / 60)), share(distinct_lines, lines, 1.0, 3.0), share(twice, n, 0.005, WORDS),
    ])


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                x = statistics_of(as_bytes(batch.column("text")))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "x"])

    return whole_texts(docs).mapInArrow(tidy(run), "doc_id long, x array<double>")


@dataclass
class Model:
    """Per class: share of training rows, mean, lower Cholesky factor of the shrunk covariance and its log-determinant."""

    centre: np.ndarray
    scale: np.ndarray
    share: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    logdets: np.ndarray

    def __post_init__(self):
        self.inverses = np.stack([np.linalg.inv(f) for f in self.factors])  # of the factors, solved once

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        if (self.share == 0).any():
            return np.full(len(x), 0.5 if (self.share == 0).all() else float(self.share[1] > 0))
        z = (x - self.centre) / self.scale
        logs = []
        for k in (0, 1):
            y = self.inverses[k] @ (z - self.means[k]).T
            logs.append(np.log(self.share[k]) - 0.5 * ((y**2).sum(0) + self.logdets[k]))
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -700, 700)))


def _train_rows(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS != 0


def _moments(labelled: DataFrame, d: int) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """Per class the number of rows, the sum and the sum of outer products; partial sums leave each task."""

    def run(batches):
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            y = batch.column("quality").to_numpy()
            x = batch.column("x").flatten().to_numpy().reshape(-1, d)
            for k in (0, 1):
                z = x[y == k]
                total[k] += np.concatenate([[len(z)], z.sum(0), (z.T @ z).ravel()])
        cells = np.arange(total.size)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(total.ravel())], ["cell", "v"])

    out = np.zeros(2 * (1 + d + d * d))
    for r in labelled.select("quality", "x").mapInArrow(run, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect():
        out[r.cell] = r.v
    return [(t[0], t[1 : 1 + d], t[1 + d :].reshape(d, d)) for t in out.reshape(2, -1)]


def fit(stats: DataFrame, labels: DataFrame, pool: float = 0.1, ridge: float = 0.02) -> Model:
    """Learns from every labelled row whose crc32(doc_id) mod 5 is not 0. Shrinkage: `pool` to the pooled covariance, `ridge` to the identity."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1)")
    d = len(STATISTICS)
    sums = _moments(stats.where(_train_rows(F.col("doc_id"))).join(marked, "doc_id"), d)
    n = np.array([s[0] for s in sums])
    if (n == 0).any():
        return Model(np.zeros(d), np.ones(d), n / max(n.sum(), 1), np.zeros((2, d)), np.stack([np.eye(d)] * 2), np.zeros(2))
    centre = sum(s[1] for s in sums) / n.sum()
    scale = np.sqrt(np.maximum(np.diag(sum(s[2] for s in sums) / n.sum()) - centre**2, 1e-12))
    scale[scale < 1e-5] = 1.0
    raw = [s[1] / s[0] for s in sums]
    means = [(m - centre) / scale for m in raw]
    covs = [(s[2] / s[0] - np.outer(m, m)) / np.outer(scale, scale) for s, m in zip(sums, raw)]
    pooled = sum(c * k for c, k in zip(covs, n)) / n.sum()
    factors = []
    for c in covs:
        c = (1 - pool) * c + pool * pooled
        factors.append(np.linalg.cholesky((1 - ridge) * c + ridge * max(np.trace(c) / d, 1e-6) * np.eye(d)))
    return Model(centre, scale, n / n.sum(), np.array(means), np.array(factors), np.array([2 * np.log(np.diag(f)).sum() for f in factors]))


def score(stats: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for rows of statistics()."""
    d = len(STATISTICS)

    def run(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, d)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    return stats.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs, any columns, without those that score below the threshold; one map pass, no shuffle."""

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                texts = [t or b"" for t in as_bytes(batch.column("text"))]
                yield batch.filter(pa.array(model.score(statistics_of(texts)) >= threshold))

    return docs.mapInArrow(tidy(run), docs.schema)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = materialize(statistics(load(spark, sf_dir, "documents")), "statistics")
    scored = score(stats, fit(stats, load(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))
