"""Operator 7, line dedup: sharded cuckoo filters backed by exact reference-count tables.

State: ``refcounts(shard, key, n)``, the exact number of documents that hold each line key (a 128-bit digest), and
``filters(shard, n_buckets, slots, exceptions)``, per shard a cuckoo filter of the keys found in at least ``min_docs``
documents, with the few other keys of the corpus that this filter would wrongly accept.  Both are tables keyed by
shard; a batch of inserted or deleted documents changes counts by +1 or -1 and inserts into or deletes from the
filter the keys that cross the threshold, so every step can be undone.

A line goes if its shard's filter accepts its key and the key is no exception, which is exact for lines of the counted
corpus.  While the filters' summed size is within ``filter_bytes`` they go to all executors and lines are dropped in one
map pass without a shuffle; beyond that, keys go to their shard's filter, a shard with many lines being asked in parts.

Nulls and odd rows: a null or empty text is one empty line; keys of fewer than ``min_chars`` code points are never
dropped; repeated rows count as documents of their own; an empty table gives an empty result; columns other than
doc_id and text are carried along unread, and those named like a column that is added get ``_in`` put to their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm.common import as_bytes, materialize, tidy

SLOTS = 4
MAX_KICKS = 500


class CuckooFilter:
    """Partial-key cuckoo filter over 16-byte digests: 16-bit fingerprints, four slots a bucket, deletions."""

    def __init__(self, n_buckets: int, table: np.ndarray | None = None):
        self.n = n_buckets
        self.table = np.zeros((n_buckets, SLOTS), np.uint16) if table is None else table

    @classmethod
    def sized_for(cls, n_keys: int) -> CuckooFilter:
        return cls(1 << max(1, int(np.ceil(np.log2(max(1, n_keys) / (SLOTS * 0.85) + 1)))))

    @classmethod
    def load(cls, n_buckets: int, data: bytes) -> CuckooFilter:
        return cls(n_buckets, np.frombuffer(data, np.uint16).reshape(n_buckets, SLOTS).copy())

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _places(self, digests: np.ndarray):
        """digests: (n, 2) uint64. Fingerprint and the first and second bucket of each."""
        prints = (digests[:, 1] & np.uint64(0xFFFF)).astype(np.uint16)
        prints[prints == 0] = 1
        first = (digests[:, 0] >> np.uint64(16)).astype(np.int64) & (self.n - 1)
        return prints, first, self._other(first, prints)

    def _other(self, bucket, print_):
        return (bucket ^ (np.asarray(print_, np.int64) * 0x5BD1E995)) & (self.n - 1)

    def contains(self, digests: np.ndarray) -> np.ndarray:
        prints, a, b = self._places(digests)
        return (self.table[a] == prints[:, None]).any(1) | (self.table[b] == prints[:, None]).any(1)

    def insert(self, digest: np.ndarray) -> bool:
        prints, a, b = self._places(digest.reshape(1, 2))
        print_, places = prints[0], (int(a[0]), int(b[0]))
        for at in places:
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = print_
                return True
        at, undo = places[0], []
        for kick in range(MAX_KICKS):
            slot = (kick * 7 + int(print_)) % SLOTS
            undo.append((at, slot, self.table[at, slot]))
            print_, self.table[at, slot] = self.table[at, slot], print_
            at = int(self._other(at, print_))
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = print_
                return True
        for at, slot, old in reversed(undo):
            self.table[at, slot] = old
        return False

    def delete(self, digest: np.ndarray) -> bool:
        prints, a, b = self._places(digest.reshape(1, 2))
        for at in (int(a[0]), int(b[0])):
            held = np.flatnonzero(self.table[at] == prints[0])
            if len(held):
                self.table[at, held[0]] = 0
                return True
        return False


@dataclass
class LineState:
    refcounts: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int
    min_chars: int


def line_key(line: bytes) -> bytes:
    """Stripped of [\\x20\\x09-\\x0D] at both ends, A-Z lower-cased (bytes methods touch ASCII only)."""
    return line.strip().lower()


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode()) >= min_chars)


def _shard(d: bytes, shards: int) -> int:
    """By bits that neither the filter's fingerprint (bytes 8 and 9) nor its buckets (2 to 7) use."""
    return int.from_bytes(d[12:16], "little") % shards


def _count_lines(shards: int, min_chars: int, sign: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[bytes, int] = {}
            for text in as_bytes(batch.column("text")):
                for key in {line_key(x) for x in (text or b"").split(b"\n")}:
                    if _long_enough(key, min_chars):
                        counts[key] = counts.get(key, 0) + sign
            keys = [digest(k) for k in counts]
            yield pa.RecordBatch.from_arrays([pa.array([_shard(k, shards) for k in keys], pa.int32()), pa.array(keys, pa.binary()), pa.array(list(counts.values()), pa.int64())], ["shard", "key", "n"])

    return run


def line_counts(docs: DataFrame, shards: int, min_chars: int = 1, sign: int = 1) -> DataFrame:
    """(shard, key, n): n documents hold the key. Summed within each Arrow batch before the shuffle."""
    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(tidy(_count_lines(shards, min_chars, sign)), "shard int, key binary, n long").groupBy("shard", "key").agg(F.sum("n").alias("n"))


def _digests(keys) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)


def _full_filter(digests: np.ndarray) -> CuckooFilter:
    made = CuckooFilter.sized_for(len(digests))
    while not all(made.insert(d) for d in digests):
        made = CuckooFilter(made.n * 2)
    return made


FILTER_SCHEMA = "shard int, n_buckets long, slots binary, exceptions binary"


def _filter_row(shard: int, made: CuckooFilter, rare: list[bytes]) -> pa.Table:
    wrong = b""
    if rare:
        hit = made.contains(_digests(rare))
        wrong = b"".join(k for k, h in zip(rare, hit) if h)
    return pa.table({"shard": pa.array([shard], pa.int32()), "n_buckets": pa.array([made.n], pa.int64()), "slots": pa.array([made.dump()], pa.binary()), "exceptions": pa.array([wrong], pa.binary())})


def _build(min_docs: int):
    def run(table: pa.Table) -> pa.Table:
        keys, n = table.column("key").to_pylist(), table.column("n").to_numpy()
        frequent = [k for k, c in zip(keys, n) if c >= min_docs]
        return _filter_row(table.column("shard")[0].as_py(), _full_filter(_digests(sorted(frequent))), [k for k, c in zip(keys, n) if c < min_docs])

    return run


def build_state(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, shard_bytes: int = 64 << 20) -> LineState:
    """Counts all lines of docs. The number of shards follows the bytes of text, so a shard's keys fit one task."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    shards = 1 << max(3, (size // shard_bytes).bit_length())
    refcounts = materialize(line_counts(docs, shards, min_chars), "line-refcounts")
    filters = materialize(refcounts.groupBy("shard").applyInArrow(_build(min_docs), FILTER_SCHEMA), "line-filters")
    return LineState(refcounts, filters, shards, min_docs, min_chars)


def _change(min_docs: int):
    def run(old: pa.Table, new: pa.Table) -> pa.Table:
        rows = list(zip(new.column("key").to_pylist(), new.column("was").to_pylist(), new.column("n").to_pylist()))
        frequent = [k for k, _, n in rows if n >= min_docs]
        rare = [k for k, _, n in rows if 0 < n < min_docs]
        shard = (new if new.num_rows else old).column("shard")[0].as_py()
        if old.num_rows:
            made = CuckooFilter.load(old.column("n_buckets")[0].as_py(), old.column("slots")[0].as_py())
            gone = [k for k, was, n in rows if was >= min_docs > n]
            came = [k for k, was, n in rows if n >= min_docs > was]
            done = all(made.delete(d) for d in _digests(gone)) and all(made.insert(d) for d in _digests(came))
            if done:
                return _filter_row(shard, made, rare)
        return _filter_row(shard, _full_filter(_digests(sorted(frequent))), rare)

    return run


def update_state(state: LineState, inserted: DataFrame | None = None, deleted: DataFrame | None = None) -> LineState:
    """The state after inserting and deleting documents; deleting what was inserted gives the earlier state back."""
    parts = [state.refcounts.select("shard", "key", F.col("n").alias("was"), F.lit(0).cast("long").alias("d"))]
    for docs, sign in ((inserted, 1), (deleted, -1)):
        if docs is not None:
            parts.append(line_counts(docs, state.shards, state.min_chars, sign).select("shard", "key", F.lit(0).cast("long").alias("was"), F.col("n").alias("d")))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    changed = materialize(both.groupBy("shard", "key").agg(F.sum("was").alias("was"), (F.sum("was") + F.sum("d")).alias("n")), "line-refcounts")
    filters = materialize(state.filters.groupBy("shard").cogroup(changed.groupBy("shard")).applyInArrow(_change(state.min_docs), FILTER_SCHEMA), "line-filters")
    return LineState(changed.where("n > 0").select("shard", "key", "n"), filters, state.shards, state.min_docs, state.min_chars)


def _split(text: bytes, gone) -> tuple[list[bytes], int]:
    lines = text.split(b"\n")
    kept = [x for x in lines if not gone(line_key(x))]
    return kept, len(lines)


class _Member:
    """Whether a key's lines go, by filters and exceptions; decisions on keys of the batch are kept in a small cache."""

    def __init__(self, rows, shards: int, min_chars: int):
        self.filters = {s: CuckooFilter(n, np.frombuffer(t, np.uint16).reshape(n, SLOTS)) for s, n, t, _ in rows}
        self.wrong = {bytes(x[i : i + 16]) for *_, x in rows for i in range(0, len(x), 16)}
        self.shards, self.min_chars = shards, min_chars
        self.empty = not any(f.table.any() for f in self.filters.values())

    def decide(self, keys: list[bytes]) -> set[bytes]:
        """Those of keys whose lines go."""
        by_shard: dict[int, list] = {}
        for k in keys:
            if _long_enough(k, self.min_chars):
                d = digest(k)
                by_shard.setdefault(_shard(d, self.shards), []).append((k, d))
        gone = set()
        for s, pairs in by_shard.items():
            if s in self.filters:
                hit = self.filters[s].contains(_digests([d for _, d in pairs]))
                gone.update(k for (k, d), h in zip(pairs, hit) if h and d not in self.wrong)
        return gone


def _apply(shared, shards: int, min_chars: int, schema: pa.Schema):
    """shared: broadcast filter rows, or None where each row brings its own `gone` digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        member = _Member(shared.value, shards, min_chars) if shared is not None else None
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                texts = [t or b"" for t in as_bytes(batch.column("text"))]
                if member is not None:
                    gone = set() if member.empty else member.decide(list({line_key(x) for t in texts for x in t.split(b"\n")}))
                    tests = [gone.__contains__] * len(texts)
                else:
                    own = [set(x or ()) for x in batch.column("tempora_gone").to_pylist()]
                    tests = [(lambda k, g=g: bool(g) and _long_enough(k, min_chars) and digest(k) in g) for g in own]
                out = [_split(t, f) for t, f in zip(texts, tests)]
                kept = [b"\n".join(k) for k, _ in out]
                made = {"kept_text": pa.array(kept, pa.binary()).cast(pa.string()), "n_lines": pa.array([n for _, n in out], pa.int64()), "n_dropped": pa.array([n - len(k) for k, n in out], pa.int64())}
                yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else batch.column(f.name).cast(f.type) for f in schema], schema=schema)

    return run


ADDED = ("kept_text", "n_lines", "n_dropped")


def _free_names(docs: DataFrame) -> DataFrame:
    """docs with `_in` put to the names of columns that would clash with added ones."""
    names = list(docs.columns)
    for i, c in enumerate(names):
        if c in ADDED:
            while names[i] in ADDED or names.count(names[i]) > 1:
                names[i] += "_in"
    return docs.toDF(*names)


def drop_frequent_lines(docs: DataFrame, state: LineState, filter_bytes: int = 64 << 20, part_rows: int = 500_000) -> DataFrame:
    """docs (any columns, with text) plus kept_text, n_lines and n_dropped; docs must be among those counted in state."""
    from pyspark.sql.pandas.types import to_arrow_schema

    docs = _free_names(docs).withColumn("text", F.col("text").cast("string"))
    out = docs.withColumn("kept_text", F.lit("")).withColumn("n_lines", F.lit(0).cast("long")).withColumn("n_dropped", F.lit(0).cast("long")).schema
    schema = to_arrow_schema(out)
    size = state.filters.agg(F.coalesce(F.sum(F.length("slots") + F.length("exceptions")), F.lit(0))).first()[0]
    if size <= filter_bytes:
        rows = [(r.shard, r.n_buckets, bytes(r.slots), bytes(r.exceptions)) for r in state.filters.collect()]
        shared = docs.sparkSession.sparkContext.broadcast(rows)
        return docs.mapInArrow(tidy(_apply(shared, state.shards, state.min_chars, schema)), out)
    text_key = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    shards, min_chars = state.shards, state.min_chars

    def pairs(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                keyed = [(h, k) for h, t in zip(batch.column("h").to_pylist(), as_bytes(batch.column("text"))) for k in {line_key(x) for x in (t or b"").split(b"\n")} if _long_enough(k, min_chars)]
                digests = [digest(k) for _, k in keyed]
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in keyed], pa.string()), pa.array([_shard(d, shards) for d in digests], pa.int32()), pa.array(digests, pa.binary())], ["h", "shard", "key"])

    def asked(filters: pa.Table, keys: pa.Table) -> pa.Table:
        if filters.num_rows and keys.num_rows:
            row = filters.slice(0, 1).to_pylist()[0]
            wrong = {row["exceptions"][i : i + 16] for i in range(0, len(row["exceptions"]), 16)}
            found = keys.column("key").to_pylist()
            hit = CuckooFilter.load(row["n_buckets"], row["slots"]).contains(_digests(found))
            return keys.select(["h", "key"]).filter(pa.array([bool(x) and k not in wrong for k, x in zip(found, hit)]))
        return keys.select(["h", "key"]).slice(0, 0)

    # a key's rows are those of the documents that hold it, so a shard's rows are known before they are made
    parts = state.refcounts.groupBy("shard").agg(F.ceil(F.sum("n") / part_rows).cast("int").alias("parts"))
    filters = state.filters.join(parts, "shard").select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).drop("parts")
    lines = docs.select(text_key.alias("h"), "text").mapInArrow(pairs, "h string, shard int, key binary").distinct().join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("h"), F.col("parts")).cast("int")).drop("parts")
    gone = filters.groupBy("shard", "part").cogroup(lines.groupBy("shard", "part")).applyInArrow(asked, "h string, key binary")
    gone = gone.groupBy("h").agg(F.collect_set("key").alias("tempora_gone")).withColumnRenamed("h", "tempora_h")
    joined = docs.withColumn("tempora_h", text_key).join(gone, "tempora_h", "left").drop("tempora_h")
    return joined.mapInArrow(_apply(None, state.shards, state.min_chars, schema), out)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tempora.llm.common import load

    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kept = drop_frequent_lines(docs, build_state(docs, min_docs=10, min_chars=1))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line, lower_key AS key FROM (
    SELECT doc_id, pos, line,
           translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_key
    FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                 generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents))),
frequent AS (SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT l.doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN f.key IS NULL THEN l.line END, chr(10) ORDER BY l.pos), '')) AS kept_sha256
FROM lines l LEFT JOIN frequent f ON l.key = f.key GROUP BY l.doc_id
"""
