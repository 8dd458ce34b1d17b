"""Operator 2, best-fit packing by length-histogram planning.

Pieces are counted by length; best-fit decreasing runs over those counts (at most `size` lengths, whatever the corpus)
and yields slots: runs of ranks within a length, the first sequence and the offset they go to. A piece takes its slot
by joining on its length and rank. Ranks are made in two levels, by (length, bucket) and then over buckets, so that a
length that most pieces share is never ranked in one task.

Nulls and odd rows: a null text is an empty one and holds only the end id; repeated rows are pieces of their own; a
null doc_id is packed too; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora.llm.common import load, materialize, shuffle_partitions, whole_texts

SIZE = 2048
#: The public split rule of byte-level BPE.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts of these characters only are merged by ranks; others go whole through the tokenizer.
PLAIN = r"[\t\n\r\x20-\x7e¡-ɏ]*"
END = b"\0\0\0\0"


def _ranks(path: str) -> tuple[dict[bytes, int] | None, str]:
    """The tokenizer's vocabulary as byte ranks, if merges in the order of ids are all it does."""
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    special = {t["content"] for t in spec["added_tokens"]}
    vocabulary = {w: i for w, i in model.get("vocab", {}).items() if w not in special}
    if model.get("type") != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex") or spec.get("normalizer") or any(c not in shown for w in vocabulary for c in w):
        return None, ""
    merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if merged != sorted(merged):
        return None, ""
    return {bytes(shown[c] for c in w): i for w, i in vocabulary.items()}, SPLIT


class TextEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, those of the tokenizer file.

    Merges run over byte ranks read from that file, which is several times as fast; texts with other than PLAIN
    characters or with a special token's string go through the tokenizer itself, as does every text of a file that
    does anything beside byte-level merges.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = regex.compile(PLAIN).fullmatch
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ranks, pattern = _ranks(path)
        self.merger = None
        if ranks:
            import tiktoken

            self.merger = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.merger and self.plain(text) and not any(s in text for s in self.special):
            ids = self.merger.encode_ordinary(text)
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def _encoder(name: str) -> TextEncoder:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import public_tokenizers

    return TextEncoder(public_tokenizers.path(name) if "/" not in name else name)


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole sequences, only the first may be shorter."""
    first = n if n <= size else n % size or size
    return [(0, first), *((s, size) for s in range(first, n, size))]


def pieces(docs: DataFrame, size: int = SIZE, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32), from the ids of each whole text and the end id 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for whole in batches:
            for start in range(0, whole.num_rows, 100):
                batch = whole.slice(start, 100)
                rows = []
                for doc, ids in zip(batch.column("doc_id").to_pylist(), map(encoder.encode, batch.column("text").to_pylist())):
                    ids += END
                    view = memoryview(ids)
                    rows += [(doc, k, s, n, zlib.crc32(view[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut(len(ids) // 4, size))]
                cols = list(zip(*rows)) if rows else [[]] * 5
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return whole_texts(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan_slots(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, end rank, first sequence, pieces a sequence, offset).

    Ranks first..end-1 of a length go, `pieces a sequence` at a time, to consecutive sequences from `first sequence`,
    one after another from `offset`. Sequences with the same room are kept as runs, so the work and the plan's size
    follow the number of lengths and not of pieces.
    """
    free: dict[int, list[tuple[int, int]]] = {}  # room left -> runs (first sequence, number)
    slots, opened = [], 0

    def place(length: int, rank: int, count: int, room: int, first: int, n: int) -> tuple[int, int]:
        """Fills sequences first..first+n-1, each of `room`, as far as count goes; returns the next rank and those used."""
        nonlocal slots
        each = room // length
        full = min(n, count // each)
        if full:
            slots.append((length, rank, rank + full * each, first, each, size - room))
            if room - each * length:
                free.setdefault(room - each * length, []).append((first, full))
            rank, count = rank + full * each, count - full * each
        if full < n and count:
            slots.append((length, rank, rank + count, first + full, count, size - room))
            if room - count * length:
                free.setdefault(room - count * length, []).append((first + full, 1))
            return rank + count, full + 1
        return rank, full

    for length in sorted((x for x, c in histogram.items() if c > 0), reverse=True):
        rank, end = 0, histogram[length]
        while rank < end:
            room = min((r for r in free if r >= length), default=None)
            if room is None:
                each = size // length
                n = -(-(end - rank) // each)
                first, opened = opened, opened + n
                rank, _ = place(length, rank, end - rank, size, first, n)
            else:
                first, n = free[room].pop()
                if not free[room]:
                    del free[room]
                rank, used = place(length, rank, end - rank, room, first, n)
                if used < n:
                    free.setdefault(room, []).append((first + used, n - used))
    return slots


def ranked(cut_pieces: DataFrame, buckets: int) -> DataFrame:
    """Adds `rank`, 0, 1, ... within each length, in a fixed order."""
    held = cut_pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = held.groupBy("length", "bucket").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("length", "bucket", before.alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))
    return held.withColumn("own", own).join(offsets, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("own") - 1).drop("bucket", "own", "before")


def pack(cut_pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """cut_pieces(length, ...) plus sequence_id and offset. The histogram and the plan have at most `size` lengths."""
    spark = cut_pieces.sparkSession
    histogram = {r.length: r["count"] for r in cut_pieces.groupBy("length").count().collect()}
    slots = plan_slots(histogram, size)
    names = "slot_length long, first_rank long, end_rank long, first_sequence long, each long, slot_offset long"
    plan = F.broadcast(spark.createDataFrame(slots, names)) if slots else spark.createDataFrame([], names)
    inside = (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank"))
    step = F.col("rank") - F.col("first_rank")
    placed = ranked(cut_pieces, max(8, shuffle_partitions(spark))).join(plan, inside)
    placed = placed.withColumn("sequence_id", F.col("first_sequence") + F.expr("(rank - first_rank) div each"))
    placed = placed.withColumn("offset", F.col("slot_offset") + (step % F.col("each")) * F.col("length"))
    return placed.drop("rank", "slot_length", "first_rank", "end_rank", "first_sequence", "each", "slot_offset")


def pack_documents(docs: DataFrame, size: int = SIZE, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    cut_pieces = materialize(pieces(docs, size, tokenizer), "pieces")
    return pack(cut_pieces, size).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("sequence_id").cast("long").alias("sequence_id"), F.col("offset").cast("long").alias("offset"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(load(spark, sf_dir, "documents"))
