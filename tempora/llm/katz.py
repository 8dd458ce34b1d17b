"""Operator 10, LM scoring: Katz backoff over Good-Turing discounted counts.

Tokens are lower-cased words and one end per text; the model is a bigram that backs off to a unigram that backs off to
one class of unknown words:

    P(w | v) = d(c(v, w)) c(v, w) / D(v)   where c(v, w) >= MIN_PAIR        (seen)
             = alpha(v) P(w)               elsewhere
    P(w)     = (1 - p0) d(c(w)) c(w) / Z   where c(w) >= 1
             = p0                          elsewhere (all unknown words together)

d is the Good-Turing discount for counts up to TURING, with absolute discounting where the counts of counts allow none.
alpha(v) is what the seen pairs of v leave over, divided by what their words leave of P, so every distribution sums to
one exactly. All pairs are counted and kept. p0 is the Good-Turing mass of the new. Where discounting leaves a context
nothing, D(v) is c(v) + 1, else c(v).

How it runs: texts never move. Each task cuts its documents into chunks of some CHUNK tokens and asks for the distinct
words and pairs of each: sorted 64-bit keys, delta-coded, dealt out by key range to shards; a chunk sends at most a row
for each of its keys. A shard adds up its keys, stores its part of the n-gram table (`ngram_table`) and answers every
chunk with the counts, in the order of the question. A second round asks for the backoff weights:
each seen pair is accounted for by one chunk that holds it, a shard adds up the contexts and answers with weights. The
last pass scores from the answers. A word or pair that makes a third of all text is one key of each chunk. Answers are
tables in the shared folder, one directory a task, so a lost executor's tasks are simply run again; a checksum of each
question guards against documents coming in another order, and the cut of the input is held fixed meanwhile.

Words stand as 64-bit hashes without a check: two of V words share one with a chance of V squared over 2 ** 65, one in a
hundred thousand at ten million words. The order is two: stored and moved bytes grow with the distinct n-grams, and three
words would double the 2.0 x input of disk that two take (the check tool's limit is 4).

Nulls and odd rows: a null or empty text is its end alone; a null doc_id is learned from and is not held out; repeated
rows count and score each; with nothing to learn from every score is 0; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm.common import as_bytes, forget_at_exit, load, materialize, new_path, shuffle_partitions, whole_texts

FOLDS, HELD_OUT = 7, 2
#: Counts up to TURING are discounted; pairs counted fewer than MIN_PAIR times would give their mass to the backoff.
TURING, MIN_PAIR = 5, 1
CHUNK = 1_000_000
SHARD_BYTES = 16 << 20
WORDS, PAIRS, CONTEXTS = 0, 1, 2
STORED = -2  # less the shard: the pid under which a shard's part of the n-gram tables stands beside the answers
END = np.uint64(xxhash.xxh64_intdigest(b"end", 1))
START = np.uint64(xxhash.xxh64_intdigest(b"start", 1))
ASK = "pid int, chunk int, kind int, shard int, keys binary, n binary, x binary, y binary"
ANSWER = "pid int, chunk int, kind int, shard int, size long, mark long, n binary, x binary, stats array<long>"


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


# packing of sorted keys and of numbers


def _squeeze(a: np.ndarray) -> bytes:
    """Byte planes, compressed: high bytes of small numbers cost next to nothing."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if planes else b"")


def _expand(data: bytes, dtype) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    if not size:
        return np.zeros(0, dtype)
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True), np.uint8)
    item = np.dtype(dtype).itemsize
    return np.ascontiguousarray(planes.reshape(item, -1).T).view(dtype).ravel()


def _squeeze_keys(keys: np.ndarray) -> bytes:
    return _squeeze(np.diff(keys, prepend=np.uint64(0)))


def _expand_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_expand(data, np.uint64), dtype=np.uint64)


def _mark(keys: np.ndarray) -> int:
    return int(np.bitwise_xor.reduce(keys, initial=np.uint64(0)).astype(np.uint64).view(np.int64))


def pair_keys(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = context * np.uint64(0x9E3779B97F4A7C15) + word
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _cuts(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The shards (a power of two, by the keys' high bits) that sorted keys fall into, and where each one's begin and the
    last one's end. Work is in proportion to the keys, however many shards there are."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    of = (keys >> np.uint64(64 - (shards.bit_length() - 1))).astype(np.int64) if shards > 1 else np.zeros(len(keys), np.int64)
    first = np.flatnonzero(np.diff(of, prepend=-1))
    return of[first], np.append(first, len(keys))


# chunks of documents


class Chunk:
    """Tokens of some documents: hashes, contexts (START before the first), document bounds, and which are learned from."""

    def __init__(self, docs: list):
        self.ids = [d for d, _ in docs]
        lengths = np.array([len(h) for _, h in docs], np.int64)
        self.words = np.concatenate([h for _, h in docs])
        self.starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        self.context = np.empty_like(self.words)
        self.context[1:] = self.words[:-1]
        self.context[self.starts] = START
        self.out = np.array([held_out(d) for d in self.ids])
        self.lengths = lengths
        self.learned = ~np.repeat(self.out, lengths)

    def pairs(self) -> np.ndarray:
        return pair_keys(self.context, self.words)


def hashed(text: bytes) -> np.ndarray:
    words = text.lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = [xxhash.xxh64_intdigest(w) for w in words]
    out[-1] = END
    return out


def _chunks(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[tuple[int, Chunk]]:
    held, size, number = [], 0, 0
    for whole in batches:
        for start in range(0, whole.num_rows, 200):
            batch = whole.slice(start, 200)
            for doc, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text"))):
                held.append((doc, hashed(text)))
                size += len(held[-1][1])
                if size >= chunk:
                    yield number, Chunk(held)
                    held, size, number = [], 0, number + 1
    if held:
        yield number, Chunk(held)


def _counted(keys: np.ndarray, learned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and how often each is learned from."""
    every = np.unique(keys)
    known, n = np.unique(keys[learned], return_counts=True)
    counts = np.zeros(len(every), np.uint32)
    counts[np.searchsorted(every, known)] = n
    return every, counts


def _asks(pid: int, number: int, kind: int, shards: int, keys: np.ndarray, *values: np.ndarray) -> pa.RecordBatch:
    full, at = _cuts(keys, shards)
    cut = [slice(a, b) for a, b in zip(at, at[1:])]
    cols = [pa.array([c] * len(full), pa.int32()) for c in (pid, number, kind)] + [pa.array(full.astype(np.int32)), pa.array([_squeeze_keys(keys[c]) for c in cut], pa.binary())]
    cols += [pa.array([_squeeze(values[i][c]) if i < len(values) else b"" for c in cut], pa.binary()) for i in range(3)]
    return pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in ASK.split(", ")])


def _ask_counts(shards: int, chunk: int):
    def run(batches):
        pid = TaskContext.get().partitionId()
        for number, c in _chunks(batches, chunk):
            yield _asks(pid, number, WORDS, shards, *_counted(c.words, c.learned))
            yield _asks(pid, number, PAIRS, shards, *_counted(c.pairs(), c.learned))

    return run


def _totals(asks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of several sorted arrays, and for the concatenated arrays the place of each and where it comes first."""
    every = np.concatenate(asks)
    order = np.argsort(every, kind="stable")
    sorted_ = every[order]
    new = np.concatenate(([True], sorted_[1:] != sorted_[:-1])) if len(every) else np.zeros(0, bool)
    place = np.empty(len(every), np.int64)
    place[order] = np.cumsum(new) - 1
    first = np.zeros(len(every), bool)
    first[order[new]] = True
    return sorted_[new], place, first


def _answers(rows: list[tuple], stats: list[int] | None, stored: tuple[bytes, bytes] = (b"", b"")) -> pa.Table:
    """The answers; the shard's part of the n-gram table (pid STORED less the shard: keys and what is known of them); its sums (pid -1)."""
    if rows:
        rows = [*rows, (STORED - rows[0][3], 0, rows[0][2], rows[0][3], 0, 0, *stored)]
    cols = list(zip(*rows)) if rows else [[]] * 8
    kinds = [pa.int32()] * 4 + [pa.int64()] * 2 + [pa.binary()] * 2
    names = [x.split()[0] for x in ANSWER.split(", ")]
    table = pa.table([pa.array(c, t) for c, t in zip(cols, kinds)] + [pa.array([None] * len(rows), pa.list_(pa.int64()))], names=names)
    if stats is not None:
        extra = pa.table([pa.array([v], t) for v, t in zip((-1, 0, rows[0][2], rows[0][3], 0, 0, b"", b""), kinds)] + [pa.array([stats], pa.list_(pa.int64()))], names=names)
        table = pa.concat_tables([table, extra])
    return table


def _answer_counts(table: pa.Table) -> pa.Table:
    """One shard: adds up the chunks' counts; answers counts and, as x, whether the chunk accounts for the key."""
    table = table.sort_by([("pid", "ascending"), ("chunk", "ascending")])
    heads = list(zip(*(table.column(c).to_pylist() for c in ("pid", "chunk", "kind", "shard"))))
    keys = [_expand_keys(k) for k in table.column("keys").to_pylist()]
    counts = np.concatenate([_expand(n, np.uint32) for n in table.column("n").to_pylist()])
    distinct, place, first = _totals(keys)
    total = np.bincount(place, weights=counts, minlength=len(distinct)).astype(np.int64)
    answer = total[place].astype(np.uint32 if len(total) == 0 or total.max() < 2**32 else np.uint64).astype(np.uint64)
    at, rows = 0, []
    for head, k in zip(heads, keys):
        rows.append((*head, len(k), _mark(k), _squeeze(answer[at : at + len(k)]), _squeeze(first[at : at + len(k)].view(np.uint8))))
        at += len(k)
    known = total[total > 0]
    held = total >= (MIN_PAIR if heads and heads[0][2] == PAIRS else 1)
    return _answers(rows, [int(known.sum()), len(known), *(int((known == r).sum()) for r in range(1, TURING + 2))], (_squeeze_keys(distinct[held]), _squeeze(total[held].astype(np.uint64))))


# discounts


def discounts(of_count: list[int], least: int = 1) -> np.ndarray:
    """d[r] for r = 0..TURING from the counts of counts n_1..n_(TURING + 1); counts below `least` are not kept."""
    n = [0, *of_count]
    d = np.ones(TURING + 1)
    d[0] = 0.0
    common = (TURING + 1) * n[TURING + 1] / n[1] if n[1] else 1.0
    for r in range(1, TURING + 1):
        ok = n[r] and common < 1
        d[r] = ((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common) if ok else -1.0
    if not all(0 < x < 1 for x in d[max(1, least) :]):
        d[1:] = [(r - 0.5) / r for r in range(1, TURING + 1)]
    d[1:least] = 0.0
    return d


class Levels:
    """What both levels need beside counts: totals, discounts, unigram probabilities."""

    def __init__(self, word_stats: list[int], pair_stats: list[int]):
        self.n, self.v = word_stats[:2]
        of = word_stats[2:]
        self.d_word, self.d_pair = discounts(of), discounts(pair_stats[2:], MIN_PAIR)
        self.p0 = 1.0 if not self.n else of[0] / self.n if 0 < of[0] < self.n else 1 / (self.n + 1)
        self.z = self.n - sum((1 - self.d_word[r]) * r * of[r - 1] for r in range(1, TURING + 1))

    def kept(self, d: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        c = c.astype(np.int64)
        return np.where(c > TURING, 1.0, d[np.minimum(c, TURING)]) * c

    def p_word(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, (1 - self.p0) * self.kept(self.d_word, c) / max(self.z, 1e-300), self.p0)


# backoff weights


class Answers:
    """The answers for one task, by chunk and kind, in the order of the sorted keys."""

    def __init__(self, paths: list[str], pid: int):
        import pyarrow.parquet as pq
        from pyarrow import fs

        self.rows: dict[tuple[int, int], list] = {}
        for path in paths:
            files, place = fs.FileSystem.from_uri(f"{path}/pid={pid}")
            for info in files.get_file_info(fs.FileSelector(place)):
                if info.base_name.endswith(".parquet"):
                    with files.open_input_file(info.path) as f:
                        for r in pq.read_table(f, columns=["chunk", "kind", "shard", "size", "mark", "n", "x"]).to_pylist():
                            self.rows.setdefault((r["chunk"], r["kind"]), []).append(r)

    def take(self, chunk: int, kind: int, keys: np.ndarray, n_type, x_type) -> tuple[np.ndarray, np.ndarray]:
        rows = sorted(self.rows.pop((chunk, kind), []), key=lambda r: r["shard"])
        if sum(r["size"] for r in rows) != len(keys) or np.bitwise_xor.reduce(np.array([r["mark"] for r in rows], np.int64), initial=0) != _mark(keys):
            raise RuntimeError("documents came in another order than when counts were asked for")
        join = lambda c, t: np.concatenate([_expand(r[c], t) for r in rows]) if rows else np.zeros(0, t)
        return join("n", n_type), join("x", x_type)


def _contexts(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every word but the end as a context, and START, which is seen as often as the end; sorted."""
    ends = counts[words == END].sum()
    keep = words != END
    at = np.searchsorted(words[keep], START)
    return np.insert(words[keep], at, START), np.insert(counts[keep], at, ends)


def _ask_weights(shards: int, chunk: int, paths: list[str], levels: Levels):
    def run(batches):
        pid = TaskContext.get().partitionId()
        answers = None
        for number, c in _chunks(batches, chunk):
            answers = answers or Answers(paths, pid)
            words = np.unique(c.words)
            n_words, _ = answers.take(number, WORDS, words, np.uint64, np.uint8)
            pairs, at = np.unique(c.pairs(), return_index=True)
            n_pairs, mine = answers.take(number, PAIRS, pairs, np.uint64, np.uint8)
            use = (mine > 0) & (n_pairs >= MIN_PAIR)
            contexts, n_contexts = _contexts(words, n_words)
            place = np.searchsorted(contexts, c.context[at[use]])
            seen = np.bincount(place, weights=levels.kept(levels.d_pair, n_pairs[use]), minlength=len(contexts))
            taken = np.bincount(place, weights=levels.p_word(n_words[np.searchsorted(words, c.words[at[use]])]), minlength=len(contexts))
            yield _asks(pid, number, CONTEXTS, shards, contexts, n_contexts, seen, taken)

    return run


def backoff(n: np.ndarray, seen: np.ndarray, taken: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 alpha and whether D is n + 1, for contexts seen n times whose pairs keep `seen` counts and `taken` of P."""
    plain = seen <= 0
    bump = ~plain & (n - seen < 1e-6 * np.maximum(n, 1))
    d = n + bump
    left = np.where(plain, 1.0, 1 - seen / np.maximum(d, 1))
    return np.where(plain, 0.0, np.log10(np.maximum(left, 1e-300)) - np.log10(np.maximum(1 - taken, 1e-300))), bump


def _answer_weights(table: pa.Table) -> pa.Table:
    table = table.sort_by([("pid", "ascending"), ("chunk", "ascending")])
    heads = list(zip(*(table.column(c).to_pylist() for c in ("pid", "chunk", "kind", "shard"))))
    keys = [_expand_keys(k) for k in table.column("keys").to_pylist()]
    n, seen, taken = (np.concatenate([_expand(v, t) for v in table.column(c).to_pylist()]) for c, t in (("n", np.uint64), ("x", np.float64), ("y", np.float64)))
    distinct, place, first = _totals(keys)
    total = np.zeros(len(distinct))
    total[place[first]] = n[first]
    # ends of a chunk are those of all chunks, so the first answer for START holds for all
    alpha, bump = backoff(total, np.bincount(place, weights=seen, minlength=len(distinct)), np.bincount(place, weights=taken, minlength=len(distinct)))
    at, rows = 0, []
    for head, k in zip(heads, keys):
        own = place[at : at + len(k)]
        rows.append((*head, len(k), _mark(k), _squeeze(alpha[own]), _squeeze(bump[own].astype(np.uint8))))
        at += len(k)
    return _answers(rows, None, (_squeeze_keys(distinct), _squeeze(alpha)))


# scores


def _score(chunk: int, paths: list[str], levels: Levels):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches):
        pid = TaskContext.get().partitionId()
        answers = None
        for number, c in _chunks(batches, chunk):
            answers = answers or Answers(paths, pid)
            words, at_word = np.unique(c.words, return_inverse=True)
            n_words, _ = answers.take(number, WORDS, words, np.uint64, np.uint8)
            pairs, at_pair = np.unique(c.pairs(), return_inverse=True)
            n_pairs, _ = answers.take(number, PAIRS, pairs, np.uint64, np.uint8)
            contexts, n_contexts = _contexts(words, n_words)
            alpha, bump = answers.take(number, CONTEXTS, contexts, np.float64, np.uint8)
            of_word = np.searchsorted(contexts, words)  # the end is never asked for as a context
            at_context = np.empty(len(at_word), np.int64)
            at_context[1:] = of_word[at_word[:-1]]
            at_context[c.starts] = np.searchsorted(contexts, START)
            log_word = np.log10(levels.p_word(n_words))
            log_base = np.log10((n_words.astype(np.float64) + 1) / (levels.n + levels.v + 1))
            n_pair = n_pairs[at_pair]
            seen = n_pair >= MIN_PAIR
            scores = alpha[at_context] + log_word[at_word]
            d = (n_contexts.astype(np.float64) + bump)[at_context[seen]]
            scores[seen] = np.log10(levels.kept(levels.d_pair, n_pair[seen]) / d)
            add = lambda x: np.add.reduceat(x, c.starts)
            cols = [pa.array(c.ids, pa.int64()), pa.array(c.out), pa.array(c.lengths), pa.array(add((n_words > 0)[at_word].astype(np.int64))), pa.array(np.full(len(c.ids), levels.n, np.int64)), pa.array(add(log_base[at_word])), pa.array(add(scores))]
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def _stable(docs: DataFrame) -> DataFrame:
    """The documents as three passes can read them in the same order: a plain scan, or else a written table."""
    plan = docs._jdf.queryExecution().executedPlan().toString()
    return docs if "Exchange" not in plan and "Sort" not in plan else materialize(docs, "texts")


def _write_answers(answers: DataFrame, name: str) -> tuple[str, DataFrame]:
    spark = answers.sparkSession
    path = new_path(spark, name)
    answers.repartition(shuffle_partitions(spark), "pid").sortWithinPartitions("pid", "chunk", "kind", "shard").write.partitionBy("pid").parquet(path)
    forget_at_exit(spark, path)
    return path, spark.read.schema(answers.schema).parquet(path)


def _stats(answers: DataFrame, kind: int) -> list[int]:
    r = answers.where((F.col("pid") == -1) & (F.col("kind") == kind)).select(F.posexplode("stats").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    found = dict((x.i, x.v) for x in r)
    return [found.get(i, 0) for i in range(TURING + 3)]


def ngram_table(spark: SparkSession, path: str, levels: Levels) -> DataFrame:
    """(kind, shard, key, value) of a written model, partitioned by key range: of words and pairs the discounted count, of
    contexts the log10 of the backoff weight. `path` is that of the counts or of the weights."""

    def run(batches):
        for batch in batches:
            for kind, shard, n, x in zip(*(batch.column(c).to_pylist() for c in ("kind", "shard", "n", "x"))):
                keys = _expand_keys(n)
                value = _expand(x, np.float64) if kind == CONTEXTS else levels.kept(levels.d_word if kind == WORDS else levels.d_pair, _expand(x, np.uint64))
                for a in range(0, len(keys), 10_000):
                    part = keys[a : a + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int32)), pa.array(np.full(len(part), shard, np.int32)), pa.array(part.view(np.int64)), pa.array(np.asarray(value[a : a + 10_000], np.float64))], ["kind", "shard", "key", "value"])

    rows = spark.read.schema(ANSWER).parquet(path).where(F.col("pid") <= STORED)
    return rows.select("kind", "shard", "n", "x").mapInArrow(run, "kind int, shard int, key long, value double")


@contextmanager
def _fixed_splits(spark: SparkSession):
    """Input files are cut alike as long as this holds, whatever executors come and go."""
    name = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(name, None)
    spark.conf.set(name, before or str(max(1, spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def score_texts(docs: DataFrame, chunk: int = CHUNK, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row a row of docs(doc_id, text), as a written table."""
    return fitted(docs, chunk, shard_bytes)[0]


def fitted(docs: DataFrame, chunk: int = CHUNK, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, Levels, str, str]:
    """The scores, the levels' totals and discounts, and where the tables of counts and of backoff weights are."""
    with _fixed_splits(docs.sparkSession):
        texts = _stable(whole_texts(docs))
        size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = 1 << max(2, (size // shard_bytes).bit_length())
        asked = texts.mapInArrow(_ask_counts(shards, chunk), ASK)
        counts, table = _write_answers(asked.groupBy("kind", "shard").applyInArrow(_answer_counts, ANSWER), "counts")
        levels = Levels(_stats(table, WORDS), _stats(table, PAIRS))
        asked = texts.mapInArrow(_ask_weights(shards, chunk, [counts], levels), ASK)
        weights, _ = _write_answers(asked.groupBy("kind", "shard").applyInArrow(_answer_weights, ANSWER), "weights")
        scored = texts.mapInArrow(_score(chunk, [counts, weights], levels), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
        return materialize(scored, "scores"), levels, counts, weights


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(load(spark, sf_dir, "documents"))
