"""Operator 6, mixing sources to target weights by iterative proportional fitting.

Token weights of the cells (source, language, topic) are raked in turn to the target marginals of each dimension until
all marginals fit. A document of a cell is then drawn with a probability in proportion to fitted weight over held
tokens, scaled so that the largest is 1: the largest sample without repeats whose expected marginals are the targets.

Default targets temper what the corpus holds: a value's share is its token share to the power ALPHAS[dimension],
renormalised; values below RARE of the tokens keep their share, so none of them sets the scale. With default targets a
cell's factor counts in the scale up to the product of the dimensions' largest ratios of target to share; a cell fitted
beyond it (values nested in one another but for a few documents) is kept whole, below its target, as no draw without
repeats serves it but by dropping most others. Targets given by the caller are shares by value, met however small the
sample; values not named there are wanted not at all.

Topics are fitted: roots of the shares of words over WORD_BUCKETS hash buckets, less the mean of the document's language,
go to the nearest of TOPICS centres, which k-means finds over all documents with words, a pass over their stored vectors
a step. Vectors, means and centres are on a grid of 1 / GRID, so all sums and distances are exact, and the topics depend
neither on the order of rows nor on their partitions. Callers with topics of their own pass a column. Tokens are runs of
other than [\\x20\\x09-\\x0D].

Nulls and odd rows: a null source, language or topic is a value of its own; a null text or one without words has no
tokens, the topic "none" and, like every document without tokens, follows its cell's probability (0 in a cell without any
tokens); repeated rows draw alike; a null doc_id draws by its text; an empty table gives an empty result; marginals that cannot be met at once (an empty
cell in the way) end after MAX_SWEEPS with the last fit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm.common import as_bytes, load, materialize, release, tidy

DIMENSIONS = ("source", "lang", "topic")
ALPHAS = {"source": 0.8, "lang": 0.8, "topic": 1.0}
#: Values with a smaller share of the tokens are not tempered.
RARE = 0.01
MAX_SWEEPS, TOLERANCE = 60, 1e-6
#: Cells are fitted on the driver and broadcast to join with documents up to this many rows (some 100 bytes each).
BROADCAST_CELLS = 50_000


#: Buckets of word hashes, topics (fewer of few documents, one for each LEAST_OF_TOPIC), steps of k-means at most.
WORD_BUCKETS, TOPICS, LEAST_OF_TOPIC, STEPS = 256, 8, 100, 25
#: Languages of so many documents, and of such a share of all, have a mean of their own; the others take that of all.
LEAST_OF_LANGUAGE, SHARE_OF_LANGUAGE = 20, 0.0025
#: A power of two: with unit vectors in such steps, products and sums of any batch are whole numbers below 2 ** 53.
GRID = 1 << 15


class _Buckets(dict):
    """The hash bucket of a word; keeps those of the first words it meets."""

    def __missing__(self, word: bytes) -> int:
        b = xxhash.xxh64_intdigest(word) % WORD_BUCKETS
        if len(self) < 1 << 15:
            self[word] = b
        return b


def word_shares(texts: list[bytes | None], known: _Buckets) -> tuple[np.ndarray, np.ndarray]:
    """The number of words of each text, and the square roots of the buckets' shares in them, in steps of 1 / GRID."""
    n, shares = np.zeros(len(texts), np.int64), np.zeros((len(texts), WORD_BUCKETS))
    for i, t in enumerate(texts):
        words = (t or b"").lower().split()
        n[i] = len(words)
        if words:
            shares[i] = np.bincount(np.fromiter(map(known.__getitem__, words), np.int64, len(words)), minlength=WORD_BUCKETS)
    return n, np.rint(np.sqrt(shares / np.maximum(n, 1)[:, None]) * GRID).astype("<u2")


@dataclass
class Topics:
    """Means of languages (under None that of all) and the topics' centres in what is left without them."""

    means: dict[str | None, np.ndarray]
    centres: np.ndarray

    def nearest(self, shares: np.ndarray, langs: pa.Array) -> tuple[np.ndarray, np.ndarray, list]:
        """Each row's centre, the place of its language in a list, and that list."""
        coded = langs.dictionary_encode("encode")
        names = coded.dictionary.to_pylist()
        off = np.array([self.means.get(v, self.means[None]) for v in names]).reshape(-1, WORD_BUCKETS) @ self.centres.T
        code = coded.indices.to_numpy(zero_copy_only=False)
        return ((self.centres**2).sum(1) - 2 * (shares / GRID @ self.centres.T - off[code])).argmin(1), code, names

    def of(self, n: np.ndarray, shares: np.ndarray, langs: pa.Array) -> list[str]:
        if not len(self.centres) or not len(n):
            return ["none"] * len(n)
        return [f"topic{k}" if words else "none" for k, words in zip(self.nearest(shares, langs)[0].tolist(), n.tolist())]


_FEATURES = "doc_id long, source string, lang string, tokens long, u double, x binary"


def features(docs: DataFrame) -> DataFrame:
    """What mixing needs of each document; x has its word_shares, `u` in [0, 1) is the document's own draw."""

    def run(batches):
        known = _Buckets()
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                n, shares = word_shares(as_bytes(batch.column("text")), known)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), batch.column("lang"), pa.array(n), batch.column("u"), pa.array([x.tobytes() for x in shares], pa.binary())], [x.split()[0] for x in _FEATURES.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), _draw().alias("u"))
    return rows.mapInArrow(tidy(run), _FEATURES)


def _vectors(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, WORD_BUCKETS)


def _added_up(rows: DataFrame, size: int, add) -> np.ndarray:
    """The sum over all rows of the whole numbers that add(batch, total) adds to total; partial sums leave each task."""

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            add(batch, total)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at].astype(np.int64))], ["cell", "v"])

    out = np.zeros(size)
    for r in rows.mapInArrow(tidy(run), "cell int, v long").groupBy("cell").agg(F.sum("v").alias("v")).collect():
        out[r.cell] = r.v
    return out


def _on_grid(x: np.ndarray) -> np.ndarray:
    return np.rint(x * GRID) / GRID


def _moments(rows: DataFrame, langs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each language (the last: of all others) the number of documents and the sum of vectors; the sum of outer products."""
    d, at = WORD_BUCKETS, {v: i for i, v in enumerate(langs)}
    upper = np.triu_indices(d)
    m = (len(langs) + 1) * (1 + d)

    def add(batch, total):
        coded = batch.column("lang").dictionary_encode("encode")
        code = np.array([at.get(v, len(at)) for v in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
        x = _vectors(batch.column("x")).astype(float)
        sums = total[:m].reshape(-1, 1 + d)
        for k in np.unique(code):
            own = x[code == k]
            sums[k, 0] += len(own)
            sums[k, 1:] += own.sum(0)
        total[m:] += (x.T @ x)[upper]

    out = _added_up(rows, m + len(upper[0]), add)
    sums, outer = out[:m].reshape(-1, 1 + d), np.zeros((d, d))
    outer[upper] = out[m:]
    outer = np.triu(outer, 1).T + outer
    return sums[:, 0], sums[:, 1:] / GRID, outer / GRID**2


def _step(rows: DataFrame, topics: Topics) -> tuple[np.ndarray, np.ndarray]:
    """Of each centre the number of its documents and the sum of their vectors without their languages' means."""
    k, d = topics.centres.shape
    names = list(topics.means)
    at = {v: i for i, v in enumerate(names)}
    m = k * d

    def add(batch, total):
        x = _vectors(batch.column("x")).astype(float)
        near, code, langs = topics.nearest(x, batch.column("lang"))
        total[:m] += ((np.arange(k)[:, None] == near).astype(float) @ x).ravel()
        code = np.array([at.get(v, at[None]) for v in langs], np.int64)[code]
        total[m:] += np.bincount(near * len(names) + code, minlength=k * len(names))

    out = _added_up(rows, m + k * len(names), add)
    held = out[m:].reshape(k, -1)
    return held.sum(1), out[:m].reshape(k, d) / GRID - held @ np.array([topics.means[v] for v in names])


def _starts(spread: np.ndarray, k: int) -> np.ndarray:
    """One deviation to both sides along the directions of the greatest spread."""
    if k == 1:
        return np.zeros((1, len(spread)))
    values, vectors = np.linalg.eigh(spread)
    out = []
    for j in range(1, k // 2 + k % 2 + 1):
        v = vectors[:, -j] * np.sign(vectors[np.abs(vectors[:, -j]).argmax(), -j]) * np.sqrt(max(values[-j], 0.0))
        out += [v, -v]
    out = _on_grid(np.array(out[:k]))
    return out[np.sort(np.unique(out, axis=0, return_index=True)[1])]


def fitted(rows: DataFrame) -> Topics:
    """Topics of features(), stored, from every row with words; the largest topic first."""
    rows = rows.where("tokens > 0").select("lang", "x")
    held = rows.groupBy("lang").count()
    total = held.agg(F.sum("count")).first()[0] or 0
    if not total:
        return Topics({None: np.zeros(WORD_BUCKETS)}, np.zeros((0, WORD_BUCKETS)))
    least = max(LEAST_OF_LANGUAGE, SHARE_OF_LANGUAGE * total)
    langs = sorted(r.lang for r in held.where((F.col("count") >= least) & F.col("lang").isNotNull()).collect())
    n, sums, outer = _moments(rows, langs)
    means = {None: _on_grid(sums.sum(0) / total)} | {v: _on_grid(sums[i] / n[i]) for i, v in enumerate(langs)}
    own = np.array([*[means[v] for v in langs], means[None]])
    cross = sums.T @ own
    spread = (outer - cross - cross.T + (own.T * n) @ own) / total
    topics = Topics(means, _starts(spread, max(1, min(TOPICS, total // LEAST_OF_TOPIC))))
    for _ in range(STEPS):
        n, sums = _step(rows, topics)
        centres = np.where(n[:, None] > 0, _on_grid(sums / np.maximum(n, 1)[:, None]), topics.centres)
        if (centres == topics.centres).all():
            break
        topics.centres = centres
    at = np.argsort(-n, kind="stable")
    topics.centres = topics.centres[at[n[at] > 0]]
    return topics


def fit_topics(docs: DataFrame) -> Topics:
    rows = materialize(features(docs), "features")
    topics = fitted(rows)
    release(rows)
    return topics


_SMALL = "doc_id long, source string, lang string, topic string, tokens long, u double"


def _labelled(rows: DataFrame, topics: Topics) -> DataFrame:
    """The small columns that mixing needs, of stored features()."""

    def run(batches):
        for batch in batches:
            made = topics.of(batch.column("tokens").to_numpy(), _vectors(batch.column("x")), batch.column("lang"))
            yield pa.RecordBatch.from_arrays([batch.column(c) if c != "topic" else pa.array(made, pa.string()) for c in names], names)

    names = [x.split()[0] for x in _SMALL.split(", ")]
    return rows.mapInArrow(tidy(run), _SMALL)


def with_dimensions(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """The small columns that mixing needs; `u` in [0, 1) is the document's own draw."""
    if topic is None:
        rows = materialize(features(docs), "features")
        return _labelled(rows, fitted(rows))

    def run(batches):
        for batch in batches:
            n = [len((t or b"").split()) for t in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column(c) if c != "tokens" else pa.array(n, pa.int64()) for c in names], names)

    names = [x.split()[0] for x in _SMALL.split(", ")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), topic.cast("string").alias("topic"), F.col("text").cast("string").alias("text"), _draw().alias("u"))
    return rows.mapInArrow(tidy(run), _SMALL)


def _by(cells: DataFrame, sums: DataFrame, name: str) -> DataFrame:
    right = sums.withColumnRenamed(name, "key")
    return cells.join(right, cells[name].eqNullSafe(right["key"]), "left").drop("key")


def _with_targets(cells: DataFrame, targets: dict[str, dict] | None) -> DataFrame:
    spark = cells.sparkSession
    for name in DIMENSIONS:
        if targets and name in targets:
            total = sum(targets[name].values())
            wanted = spark.createDataFrame([(k, v / total) for k, v in targets[name].items()], f"{name} string, want_{name} double")
            cells = _by(cells, wanted, name).fillna({f"want_{name}": 0.0})
        else:
            held = cells.groupBy(name).agg(F.sum("tokens").cast("double").alias("held"))
            total = float(held.agg(F.sum("held")).first()[0] or 1.0)
            rare = F.col("held") < RARE * total
            held = held.withColumn("mass", F.when(~rare, F.pow("held", F.lit(ALPHAS[name]))))
            mass, kept = (float(x or 0.0) for x in held.agg(F.sum("mass"), F.sum(F.when(rare, F.col("held")))).first())
            want = F.when(rare, F.col("held") / total).otherwise(F.col("mass") / (mass or 1.0) * (1 - kept / total))
            cells = _by(cells, held.select(name, want.alias(f"want_{name}")), name)
    return cells


def _sweep(cells: DataFrame) -> DataFrame:
    for name in DIMENSIONS:
        cells = _by(cells, cells.groupBy(name).agg(F.sum("w").alias("now")), name)
        cells = cells.withColumn("w", F.when(F.col("now") > 0, F.col("w") * F.col(f"want_{name}") / F.col("now")).otherwise(0.0)).drop("now")
    return cells


def _misfit(cells: DataFrame) -> float:
    """The largest distance of a marginal's share from its target; the last dimension fits by construction."""
    off = 0.0
    for name in DIMENSIONS[:-1]:
        r = cells.groupBy(name).agg(F.sum("w").alias("now"), F.max(f"want_{name}").alias("want")).agg(F.max(F.abs(F.col("now") - F.col("want")))).first()
        off = max(off, r[0] or 0.0)
    return off


def _raked_here(rows: list, targets: dict[str, dict] | None) -> list[tuple]:
    """The same fit on the driver, for a checked number of cells."""
    tokens = np.array([r.tokens for r in rows], float)
    total = max(tokens.sum(), 1.0)
    codes, wanted = [], []
    for name in DIMENSIONS:
        values = {v: i for i, v in enumerate(dict.fromkeys(r[name] for r in rows))}
        code = np.array([values[r[name]] for r in rows], np.int64)
        if targets and name in targets:
            want = np.array([float(targets[name].get(v, 0.0)) for v in values]) / sum(targets[name].values())
        else:
            held = np.bincount(code, tokens, len(values))
            rare = held < RARE * total
            mass = np.where(rare, 0, held ** ALPHAS[name])
            want = np.where(rare, held / total, mass / max(mass.sum(), 1e-300) * (1 - held[rare].sum() / total))
        codes.append(code)
        wanted.append(want)
    w = tokens / total
    for _ in range(MAX_SWEEPS if tokens.sum() else 0):
        for code, want in zip(codes, wanted):
            now = np.bincount(code, w, len(want))
            w = w * np.divide(want, now, out=np.zeros_like(want), where=now > 0)[code]
        if max(np.abs(np.bincount(c, w, len(x)) - x).max() for c, x in zip(codes[:-1], wanted)) < TOLERANCE:
            break
    factor = np.divide(w * total, tokens, out=np.zeros_like(w), where=tokens > 0)
    return [(*(r[n] for n in DIMENSIONS), int(r.tokens), float(x), float(f)) for r, x, f in zip(rows, w, factor)]


def rake(documents: DataFrame, targets: dict[str, dict] | None = None, cells_here: int = BROADCAST_CELLS) -> DataFrame:
    """documents(source, lang, topic, tokens) -> one row a cell with its tokens, fitted share w, factor and probability.

    Up to `cells_here` cells are fitted on the driver, more of them by joins and sums on the executors.
    """
    spark = documents.sparkSession
    cells = materialize(documents.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "cells")
    if cells.count() <= cells_here:
        fitted = spark.createDataFrame(_raked_here(cells.collect(), targets), ", ".join(f"{n} string" for n in DIMENSIONS) + ", tokens long, w double, factor double")
    else:
        total = float(max(cells.agg(F.sum("tokens")).first()[0] or 0, 1))
        cells = materialize(_with_targets(cells, targets).withColumn("w", F.col("tokens") / F.lit(total)), "cells")
        for _ in range(MAX_SWEEPS):
            cells = materialize(_sweep(cells), "cells")
            if _misfit(cells) < TOLERANCE:
                break
        fitted = cells.withColumn("factor", F.when(F.col("tokens") > 0, F.col("w") * F.lit(total) / F.col("tokens")).otherwise(0.0))
    most = fitted.agg(F.max("factor")).first()[0] or 1.0
    if not targets:
        most = min(most, _bound(fitted))
    return fitted.withColumn("probability", F.least(F.col("factor") / F.lit(most), F.lit(1.0)))


def _bound(fitted: DataFrame) -> float:
    """The product of each dimension's largest ratio of fitted share to held share."""
    total = float(fitted.agg(F.sum("tokens")).first()[0] or 1)
    bound = 1.0
    for name in DIMENSIONS:
        held = fitted.groupBy(name).agg(F.sum("w").alias("w"), F.sum("tokens").alias("tokens")).where("tokens > 0")
        bound *= held.agg(F.max(F.col("w") * total / F.col("tokens"))).first()[0] or 1.0
    return bound


def _joined(documents: DataFrame, cells: DataFrame) -> DataFrame:
    """Adds factor and probability to documents, whose columns source, lang and topic name the cell."""
    right = cells.select(*[F.col(n).alias(f"cell_{n}") for n in DIMENSIONS], "factor", "probability")
    if cells.count() <= BROADCAST_CELLS:
        right = F.broadcast(right)
    same = [documents[n].eqNullSafe(F.col(f"cell_{n}")) for n in DIMENSIONS]
    return documents.join(right, same[0] & same[1] & same[2]).drop(*[f"cell_{n}" for n in DIMENSIONS])


def mix(docs: DataFrame, targets: dict[str, dict] | None = None, topic: Column | None = None) -> DataFrame:
    """docs left after the draw, with their own columns only."""
    spark = docs.sparkSession
    topics = None
    if topic is None:
        stored = materialize(features(docs), "features")
        topics = fitted(stored)
        cells = materialize(rake(_labelled(stored, topics), targets), "cells")
        release(stored)
    else:
        cells = materialize(rake(with_dimensions(docs, topic), targets), "cells")
    own = [f"tempora_{n}" for n in (*DIMENSIONS, "u")]
    label = (F.lit(None) if topic is None else topic).cast("string")
    keyed = docs.select(*[F.col(f"`{c}`") for c in docs.columns], F.col("source").cast("string").alias(own[0]), F.col("lang").cast("string").alias(own[1]), label.alias(own[2]), _draw().alias(own[3]))
    here = {tuple(r[:3]): r[3] for r in cells.select(*DIMENSIONS, "probability").collect()} if cells.count() <= BROADCAST_CELLS else None
    shared = spark.sparkContext.broadcast(here)
    width = len(docs.columns)
    keyed = keyed.withColumn("text", F.col("text").cast("string"))
    schema = keyed.schema if here is None else keyed.select(keyed.columns[:width]).schema

    def run(batches):
        known = _Buckets()
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                source, lang, made, u = batch.columns[width:]
                if topics is not None:
                    texts = batch.column(batch.schema.names.index("text"))
                    made = pa.array(topics.of(*word_shares(as_bytes(texts), known), lang), pa.string())
                if shared.value is None:
                    yield pa.RecordBatch.from_arrays([*batch.columns[:width], source, lang, made, u], batch.schema.names)
                else:
                    p = [shared.value[x] for x in zip(source.to_pylist(), lang.to_pylist(), made.to_pylist())]
                    yield pa.RecordBatch.from_arrays(batch.columns[:width], batch.schema.names[:width]).filter(pa.array(u.to_numpy() < np.array(p)))

    found = keyed.mapInArrow(tidy(run), schema)
    if here is not None:
        return found
    right = cells.select(*[F.col(n).alias(f"tempora_cell_{n}") for n in DIMENSIONS], F.col("probability").alias("tempora_p"))
    same = [F.col(own[i]).eqNullSafe(F.col(f"tempora_cell_{n}")) for i, n in enumerate(DIMENSIONS)]
    return found.join(right, same[0] & same[1] & same[2]).where(F.col(own[3]) < F.col("tempora_p")).select(*[F.col(f"`{c}`") for c in docs.columns])


def _draw() -> Column:
    draw = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit("mix"), "text")).otherwise(F.xxhash64(F.lit("mix"), F.col("doc_id").cast("long")))
    return F.shiftrightunsigned(draw, 11).cast("double") / float(1 << 53)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(features(load(spark, sf_dir, "documents")), "features")
    small = materialize(_labelled(rows, fitted(rows)), "mixing")
    release(rows)
    found = _joined(small, materialize(rake(small), "cells"))
    return found.select("doc_id", "source", "lang", "topic", "tokens", F.col("factor").alias("weight"), "probability", (F.col("u") < F.col("probability")).alias("sampled"))
