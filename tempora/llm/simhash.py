"""Operator 4, SimHash near-dedup by the generalised pigeonhole principle.

The 64 bits are grouped into partitions of correlated bits; thresholds e_1..e_m with sum(e_i) = radius - m + 1 are
allotted by dynamic programming on estimated candidate counts. Two fingerprints within the radius then agree up to
e_i bits in at least one partition i, so probing each partition within its threshold and verifying the survivors finds
every link. A threshold of -1 leaves a partition out.

Links are found between distinct fingerprints, so copies cost nothing; each group of equal partition values gives a
spanning set of its links, not all pairs. Groups beyond ``group_cap`` members take another exact way, in which a link
is found through a bit pattern one flip from one end and two flips from the other: rows in proportion to members.

Nulls and odd rows: a null or empty text has fingerprint zero; a null doc_id takes part but never names a component
(null if no row of the component has an id); repeated rows give repeated results; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora.llm.common import as_bytes, load, materialize, scratch, shuffle_partitions, tidy, whole_texts
from tempora.llm.components import components, spanning

BITS = 64
CHUNK = 1 << 16
#: Above every ordinary id: stands for a null doc_id inside the operator.
NO_ID = 1 << 62


# fingerprints


def shingle_hashes(text: bytes, width: int = 3) -> list[int]:
    """XXH64, seed 42, of every `width`-word shingle, repeats included; bytes methods lower and split ASCII only."""
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, 42)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], 42) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())]


def _bit_sums(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.add.reduceat(bits, starts, axis=0, dtype=np.uint32)


def _pack(over: np.ndarray) -> np.ndarray:
    return np.packbits(over, axis=1, bitorder="little").view(np.uint64).ravel()


def _majority(hashes: np.ndarray) -> np.uint64:
    """The fingerprint of many hashes, repeats included."""
    sums = sum(_bit_sums(hashes[a : a + CHUNK], np.array([0])).astype(np.int64) for a in range(0, len(hashes), CHUNK))
    return _pack(2 * sums > len(hashes))[0]


def fingerprints_of(texts: list[bytes], width: int = 3) -> np.ndarray:
    """One uint64 a text. Works on runs of some 65,536 shingles; a longer text is summed in pieces."""
    out = np.zeros(len(texts), np.uint64)
    held: list[np.ndarray] = []
    at: list[int] = []
    size = 0

    def flush():
        nonlocal held, at, size
        if at:
            lengths = np.array([len(x) for x in held])
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            out[at] = _pack(2 * _bit_sums(np.concatenate(held), starts) > lengths[:, None])
        held, at, size = [], [], 0

    for i, text in enumerate(texts):
        hashes = np.array(shingle_hashes(text, width), np.uint64)
        if len(hashes) > CHUNK:
            out[i] = _majority(hashes)
        elif len(hashes):
            held.append(hashes)
            at.append(i)
            size += len(hashes)
            if size >= CHUNK:
                flush()
    flush()
    return out


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                fps = fingerprints_of(as_bytes(batch.column("text")), width)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return whole_texts(docs).mapInArrow(tidy(run), "doc_id long, fp long")


# partitions and thresholds


def correlated_groups(moments: np.ndarray, n: float, m: int) -> list[list[int]]:
    """m groups of about equal size; each starts at the free bit with the strongest ties and takes the closest bits."""
    mean = np.diag(moments) / max(n, 1)
    cov = moments / max(n, 1) - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
    ties = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(ties, 0)
    free, groups = list(range(BITS)), []
    for k in range(m):
        size = len(free) // (m - k)
        group = [max(free, key=lambda b: (ties[b, free].sum(), -b))]
        free.remove(group[0])
        while len(group) < size:
            group.append(max(free, key=lambda b: (ties[b, group].sum(), -b)))
            free.remove(group[-1])
        groups.append(sorted(group))
    return groups


def _ball(width: int, radius: int) -> int:
    total, term = 0, 1
    for k in range(radius + 1):
        total += term
        term = term * (width - k) // (k + 1)
    return total


def _growth(bit_means: np.ndarray, radius: int) -> float:
    """How many times as many pairs agree within `radius` bits as agree in all, if bits were independent."""
    agree = bit_means**2 + (1 - bit_means) ** 2
    chance = np.zeros(radius + 2)
    chance[0] = 1
    for p in agree:
        chance[1:] = chance[1:] * p + chance[:-1] * (1 - p)
        chance[0] *= p
    return float(chance[: radius + 1].sum() / max(chance[0], 1e-300))


def allot(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """The cheapest thresholds with the given sum; costs[i][e] is partition i's cost at threshold e (-1: left out)."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for s, (c, picked) in best.items():
            for e, x in cost.items():
                if s + e not in nxt or c + x < nxt[s + e][0]:
                    nxt[s + e] = (c + x, [*picked, e])
        best = nxt
    return best[total]


def plan(n: int, moments: np.ndarray, equal_pairs: dict[tuple[int, int], float], groups: dict[int, list[list[int]]], radius: int, row_cost: float = 100.0) -> tuple[list[list[int]], list[int]]:
    """The cheapest choice of partitions and thresholds; a probe row costs as much as `row_cost` verified pairs."""
    means, choices = np.diag(moments) / max(n, 1), []
    for m, parts in groups.items():
        costs = []
        for i, bits in enumerate(parts):
            cost = {-1: 0.0}
            for e in range(min(radius, 2) + 1):
                rows = n * (1 if e == 0 else 1 + _ball(len(bits), e))
                cost[e] = row_cost * rows + equal_pairs[m, i] * _growth(means[bits], e)
            costs.append(cost)
        choices.append((*allot(costs, radius - m + 1), parts))
    _, thresholds, parts = min(choices, key=lambda x: x[0])
    return parts, thresholds


def _moments(nodes: DataFrame) -> np.ndarray:
    """64 x 64 counts of bits set together, over all distinct fingerprints."""

    def run(batches):
        total = np.zeros((BITS, BITS))
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint8).reshape(-1, 8)
            for a in range(0, len(fps), CHUNK):
                bits = np.unpackbits(fps[a : a + CHUNK], axis=1, bitorder="little").astype(np.float32)
                total += bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS), pa.int32()), pa.array(total.ravel())], ["cell", "n"])

    sums = nodes.select("fp").mapInArrow(run, "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BITS * BITS)
    for r in sums:
        out[r.cell] = r.n
    return out.reshape(BITS, BITS)


def _mask(bits: list[int]) -> np.uint64:
    return np.uint64(sum(1 << b for b in bits))


def _part_counts(nodes: DataFrame, groups: dict[int, list[list[int]]]) -> dict[tuple[int, int], float]:
    """For each partition of each grouping, the number of pairs of fingerprints that agree there."""
    masks = [(m, i, int(_mask(bits).view(np.int64))) for m, parts in groups.items() for i, bits in enumerate(parts)]
    rows = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(mask)).alias("v")) for m, i, mask in masks])
    counted = nodes.select(F.explode(rows).alias("x")).groupBy("x").count()
    pairs = counted.groupBy("x.m", "x.i").agg(F.sum(F.col("count") * (F.col("count") - 1) / 2).alias("pairs"))
    return {(m, i): 0.0 for m, i, _ in masks} | {(r.m, r.i): float(r.pairs) for r in pairs.collect()}


# probing and verifying


def _patterns(bits: list[int], low: int, high: int) -> np.ndarray:
    return np.array([int(_mask(list(c))) for k in range(low, high + 1) for c in combinations(bits, k)], np.uint64)


def _probe_rows(parts: list[list[int]], thresholds: list[int]):
    """Each fingerprint under its value in each partition (role 0), and under every value within e bits (role 1)."""
    work = [(i, _mask(b), _patterns(b, 1, e) if e > 0 else np.zeros(0, np.uint64)) for i, (b, e) in enumerate(zip(parts, thresholds)) if e >= 0]

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 5000):
                batch = whole.slice(start, 5000)
                fps = batch.column("fp").to_numpy().view(np.uint64)
                for i, mask, flips in work:
                    values = fps & mask
                    for role, v in ((0, values), *(((1, (values[:, None] ^ flips[None, :]).ravel()),) if len(flips) else ())):
                        each = len(v) // max(1, len(fps))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i, np.int32)), pa.array(v.view(np.int64)), pa.array(np.full(len(v), role, np.int8)), pa.array(np.repeat(fps, each).view(np.int64))], ["part", "value", "role", "fp"])

    return run


LINK_RUN = 1 << 20


def _links_within(part: np.ndarray, value: np.ndarray, role: np.ndarray, fp: np.ndarray, radius: int):
    """Rows are sorted by part, value and role. Compares each exact row with the k-th next of its group, k = 1, 2, ..."""
    if not len(fp):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    new = np.concatenate(([True], (part[1:] != part[:-1]) | (value[1:] != value[:-1])))
    ends = np.append(np.flatnonzero(new)[1:], len(fp))
    left = ends[np.cumsum(new) - 1] - np.arange(len(fp)) - 1  # rows of the group after this one
    at = np.flatnonzero((left > 0) & (role == 0))  # exact rows come first; two probes need not meet
    a_all, b_all, held, k = [], [], 0, 1
    while len(at):
        other = at + k
        near = (np.bitwise_count(fp[at] ^ fp[other]) <= radius) & (fp[at] != fp[other])
        if near.any():
            a_all.append(fp[at[near]])
            b_all.append(fp[other[near]])
            held += int(near.sum())
            if held > LINK_RUN:
                a, b = spanning(np.concatenate(a_all), np.concatenate(b_all))
                a_all, b_all, held = [a], [b], len(a)
        k += 1
        at = at[left[at] >= k]
    return spanning(np.concatenate(a_all), np.concatenate(b_all)) if a_all else (np.zeros(0, np.uint64),) * 2


def _verify(radius: int, group_cap: int):
    """Streams sorted groups. kind 0: a link u-v. kind 1: fingerprint u of a group too large, of partition v."""
    names = ["kind", "u", "v"]

    def emit(kind, u, v):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(u), kind, np.int8)), pa.array(np.ascontiguousarray(u).view(np.int64)), pa.array(np.ascontiguousarray(v).view(np.int64))], names)

    def settle(cols):
        """All groups of cols are whole."""
        part, value, role, fp = cols
        new = np.concatenate(([True], (part[1:] != part[:-1]) | (value[1:] != value[:-1])))
        size = np.diff(np.append(np.flatnonzero(new), len(fp)))[np.cumsum(new) - 1]
        big = size > group_cap
        if big.any():
            yield emit(1, fp[big], part[big].astype(np.uint64))
            part, value, role, fp = (c[~big] for c in (part, value, role, fp))
        u, v = _links_within(part, value, role, fp, radius)
        if len(u):
            yield emit(0, u, v)

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column("part").to_numpy(), batch.column("value").to_numpy(), batch.column("role").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)]
            cols = cols if held is None else [np.concatenate(p) for p in zip(held, cols)]
            last = int(np.flatnonzero((cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]))[0])
            if len(cols[0]) - last > group_cap:  # more than the cap of one group: these go the other way, one row is kept to know it
                yield emit(1, cols[3][last + 1 :], cols[0][last + 1 :].astype(np.uint64))
                cols = [np.concatenate([c[: last + 1], np.repeat(c[last : last + 1], group_cap)]) for c in cols]
            if last:
                yield from settle([c[:last] for c in cols])
            held = [c[last:] for c in cols]
        if held is not None:
            yield from settle(held)

    return run


def _far_links(members: DataFrame, parts: list[list[int]], thresholds: list[int], radius: int) -> DataFrame:
    """Exact links of fingerprints u that share a crowded value of partition v, through patterns between the two ends.

    Ends at distance d <= radius meet at a pattern `near` flips from one and `radius - near` from the other. Where the
    threshold is 0 both ends agree in the partition, so only other bits are flipped.
    """
    near = radius // 2
    flips = {}
    for i, (bits, e) in enumerate(zip(parts, thresholds)):
        other = [b for b in range(BITS) if b not in bits] if e == 0 else list(range(BITS))
        flips[i] = (_patterns(other, 0, near), _patterns(other, near + 1, radius - near))

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 200):
                batch = whole.slice(start, 200)
                for fp, part in zip(batch.column("u").to_numpy().view(np.uint64), batch.column("v").to_numpy()):
                    close, far = flips[int(part)]
                    z = np.concatenate([fp ^ close, fp ^ far])
                    is_close = np.zeros(len(z), bool)
                    is_close[: len(close)] = True
                    yield pa.RecordBatch.from_arrays([pa.array(z.view(np.int64)), pa.array(np.full(len(z), fp).view(np.int64)), pa.array(is_close)], ["z", "fp", "close"])

    met = members.distinct().mapInArrow(run, "z long, fp long, close boolean")
    hub = met.groupBy("z").agg(F.min(F.when(F.col("close"), F.col("fp"))).alias("hub"), F.count("*").alias("n")).where("hub is not null and n > 1")
    return met.join(hub, "z").where("fp <> hub").select(F.col("fp").alias("u"), F.col("hub").alias("v")).distinct()


def planned(nodes: DataFrame, radius: int) -> tuple[list[list[int]], list[int]]:
    """Partitions and thresholds for nodes(fp), from bit moments and collision counts of all of them."""
    n = nodes.count()
    moments = _moments(nodes)
    groups = {m: correlated_groups(moments, n, m) for m in range(2, radius + 2)} if radius > 0 else {1: [list(range(BITS))]}
    return plan(n, moments, _part_counts(nodes, groups), groups, radius)


def links(nodes: DataFrame, radius: int = 3, group_cap: int = 20000) -> DataFrame:
    """nodes(fp), distinct -> (u, v): links that connect whatever all pairs within the radius connect."""
    spark = nodes.sparkSession
    parts, thresholds = planned(nodes, radius)
    rows = nodes.select("fp").mapInArrow(_probe_rows(parts, thresholds), "part int, value long, role byte, fp long")
    values = F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(int(_mask(b).view(np.int64)))).alias("value")) for i, (b, e) in enumerate(zip(parts, thresholds)) if e >= 0])
    hot = materialize(nodes.select(F.explode(values).alias("x")).groupBy("x.part", "x.value").count().where(F.col("count") > group_cap).select("part", "value", F.lit(True).alias("hot")), "crowded-values")
    crowded = None
    if hot.head(1):  # rows of a crowded value, probes included, never meet in one task
        rows = rows.join(_bounded(hot), ["part", "value"], "left")
        crowded = rows.where("hot").select(F.col("fp").alias("u"), F.col("part").cast("long").alias("v"))
        rows = rows.where("hot is null").drop("hot")
    found = rows.repartition(shuffle_partitions(spark), "part", "value").sortWithinPartitions("part", "value", "role").mapInArrow(_verify(radius, group_cap), "kind byte, u long, v long")
    found = materialize(found, "links")
    near = found.where("kind = 0").select("u", "v")
    more = found.where("kind = 1").select("u", "v")
    crowded = more if crowded is None else more.unionByName(crowded)
    return near.unionByName(_far_links(crowded, parts, thresholds, radius)) if crowded.head(1) else near


def near_duplicates(docs: DataFrame, radius: int = 3, width: int = 3, group_cap: int = 20000) -> DataFrame:
    """(doc_id, fp, component_id), one row a document; component_id is the smallest doc_id reachable over links."""
    prints = materialize(fingerprints(docs, width), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes, radius, group_cap)).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    member = materialize(nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "members")
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(member.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


# similar texts, for deduplication


class _WordHashes(dict):
    """XXH64 of words; keeps those of the first MOST words it meets, as words repeat."""

    MOST = 1 << 15

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < self.MOST:
            self[word] = h
        return h


def _mixed(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        z = (z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return z ^ (z >> np.uint64(32))


def word_shingles(words: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every run of `width` words, given the words' hashes; of fewer words, of them all."""
    n = len(words)
    if not n:
        return words
    runs = max(1, n - width + 1)
    out = np.full(runs, min(n, width), np.uint64)
    for j in range(min(n, width)):
        out = _mixed(out + words[j : j + runs])
    return out


def _hashes_of(text: bytes | None, known: _WordHashes) -> np.ndarray:
    words = (text or b"").lower().split()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


#: Ids are broadcast to pick out documents up to this many (8 bytes each); beyond, they are joined by a shuffle.
BROADCAST_IDS = 500_000


def _bounded(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


#: Documents whose shingles are counted to find hot ones, and the count in that sample from which one is hot. Hot ones
#: go last in the order of shingles; any order is exact, so the sample bears on cost only.
SAMPLE_DOCS, HOT, MOST_HOT = 20_000, 8, 100_000
#: Rows of one key beyond this many are dealt over blocks of them, and pairs of such blocks.
HOT_BLOCK = 2_000
#: Rows of a key that more rows than this hold carry the marks of their sets: only there pairs could outgrow rows.
CROWDED = 64
#: Bits of a set's marks; some four times the shingles in which sets of usual texts may differ and be similar still.
MARKS = 512
#: Rows that are paired at a time, and pairs held before repeats are taken out.
JOIN_ROWS, JOIN_PAIRS = 1 << 16, 1 << 18
#: Pairs verified at once (or a tenth of the documents), and the rounds that thin more of them by components first.
VERIFY_PAIRS, THIN_ROUNDS = 20_000, 4
#: Leaders of a key when every document tries one hub.
LEADERS = 4


def _shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    def run(batches):
        known = _WordHashes()
        for batch in batches:
            for start in range(0, batch.num_rows, 100):
                part = batch.slice(start, 100)
                sets = [np.unique(word_shingles(_hashes_of(t, known), words)).view(np.int64) for t in as_bytes(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, shingles array<long>")


def _hot_shingles(docs: DataFrame, words: int) -> np.ndarray:
    """Hashes, ascending by their count in a sample of documents."""
    every = max(1, -(-docs.count() // SAMPLE_DOCS))
    sample = _shingle_sets(docs.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(every)) == 0), words)
    found = sample.select(F.explode("shingles").alias("s")).groupBy("s").count().where(F.col("count") >= HOT).orderBy(F.col("count").desc(), "s").limit(MOST_HOT).toArrow()
    return found.column("s").to_numpy()[::-1].view(np.uint64)


def _ordered(hashes: np.ndarray, hot: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, int]:
    """Distinct hashes, given by value, with hot ones (sorted, of the given ranks) after the others by rank; and how many
    others there are."""
    if not len(hot):
        return hashes, len(hashes)
    at = np.minimum(np.searchsorted(hot, hashes), len(hot) - 1)
    is_hot = hot[at] == hashes
    return np.concatenate([hashes[~is_hot], hot[at[is_hot][np.argsort(rank[at[is_hot]])]]]), len(hashes) - int(is_hot.sum())


def _marks(hashes: np.ndarray) -> bytes:
    """Of each of MARKS buckets whether an odd number of the hashes, distinct ones, falls into it. Two sets differ in as
    many hashes as their marks do in bits, or in more."""
    odd = np.bincount((hashes % np.uint64(MARKS)).astype(np.int64), minlength=MARKS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


SKETCH = "doc_id long, set_a long, set_b long, n long, head array<long>, cold long, marks binary"


def _sketches(docs: DataFrame, hot: np.ndarray, similarity: float, words: int) -> DataFrame:
    """One row a document: a 128-bit key of its set of `words`-word shingles, their number n, and the first
    n - ceil(similarity n) + 1 of them in the one order of all, of which the first `cold` are not hot, and its marks. Similar
    texts share one of these."""
    rank = np.argsort(hot)
    sorted_hot = hot[rank]

    def run(batches):
        known = _WordHashes()
        for whole in batches:
            for start in range(0, whole.num_rows, 100):
                batch = whole.slice(start, 100)
                keys, sizes, heads, cold, marks = [], [], [], [], []
                for text in as_bytes(batch.column("text")):
                    tokens = np.unique(word_shingles(_hashes_of(text, known), words))
                    n = len(tokens)
                    keys.append(xxhash.xxh3_128_digest(tokens.tobytes()))
                    sizes.append(n)
                    ordered, others = _ordered(tokens, sorted_hot, rank)
                    heads.append(ordered[: n - int(np.ceil(similarity * n - 1e-9)) + 1 if n else 0].view(np.int64))
                    cold.append(others)
                    marks.append(_marks(tokens))
                key = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
                cols = [batch.column("doc_id"), pa.array(key[:, 0].copy()), pa.array(key[:, 1].copy()), pa.array(sizes, pa.int64()), pa.array(heads, pa.list_(pa.int64())), pa.array(cold, pa.int64()), pa.array(marks, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in SKETCH.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), SKETCH)


def _verified(docs: DataFrame, pairs: DataFrame, similarity: float, words: int) -> DataFrame:
    """(u, v): the pairs (a, b) whose sets of `words`-word shingles are similar. Only their texts are read again."""
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "candidate-ids")
    sets = materialize(_shingle_sets(docs.join(_bounded(ids), "doc_id", "left_semi"), words), "shingle-sets")
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    similar = both.withColumn("shared", shared).where((F.col("shared") > 0) & (F.col("shared") >= similarity * (F.size("x") + F.size("y") - F.col("shared"))))
    return similar.select(F.col("a").alias("u"), F.col("b").alias("v"))


def _met_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, those whose key another row has too. Holds one row back, never a key's rows."""
    last = None
    again = False  # whether `last` has met its key before
    for batch in batches:
        if not batch.num_rows:
            continue
        if last is not None:
            batch = pa.concat_batches([last, batch])
        key = batch.column("key").to_numpy()
        same = key[1:] == key[:-1]
        met = np.concatenate(([again], same)) | np.concatenate((same, [False]))
        again = bool(met[-1])
        last = batch.slice(batch.num_rows - 1)
        yield batch.slice(0, batch.num_rows - 1).filter(pa.array(met[:-1]))
    if last is not None and again:
        yield last


def _whole_keys(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by key (the first of names), some JOIN_ROWS at a time, no key's rows apart."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
        size += batch.num_rows
        if size < JOIN_ROWS or held[-1][0][-1] == held[0][0][0]:
            continue
        cols = [np.concatenate(c) for c in zip(*held)]
        last = int(np.searchsorted(cols[0], cols[0][-1]))  # the last key's rows may go on
        yield [c[:last] for c in cols]
        held = [[c[last:].copy() for c in cols]]
        size = len(cols[0]) - last
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def _least(similarity: float, n_a, n_b) -> np.ndarray:
    """How many keys two heads must share: what similar sets share, less all that lies beyond the head of the larger."""
    share = similarity / (1 + similarity)
    return np.ceil(share * (n_a + n_b) - 1e-6 - (np.ceil(similarity * np.maximum(n_a, n_b) - 1e-9) - 1)).astype(np.int64)


def _fit(similarity: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether two rows of a key, each (n, place, before, own), may be of similar sets.

    Up to the key a pair shares no more than what either has before it, and from there on no more than the rest of
    either: of all shingles, and of those of the heads that anybody shares.
    """
    share = similarity / (1 + similarity)
    near = np.minimum(a[0], b[0]) >= similarity * np.maximum(a[0], b[0]) - 1e-9
    most = np.minimum(a[1], b[1]) + np.minimum(a[0] - a[1], b[0] - b[1])
    met = np.minimum(a[2], b[2]) + np.minimum(a[3] - a[2], b[3] - b[2])
    return near & (most >= share * (a[0] + b[0]) - 1e-6) & (met >= _least(similarity, a[0], b[0]))


def _stars(similarity: float):
    """Rows sorted by key and falling centrality -> (hub, doc, met, least): each row with the first leader of its key that
    it may be similar to; a row without one becomes a leader, LEADERS a key at most. Rows in proportion to rows."""

    def run(batches):
        for key, _, place, before, own, doc in _whole_keys(batches, ("key", "order", "place", "before", "own", "doc_id")):
            row = np.stack([place >> 32, place & 0xFFFFFFFF, before, own])
            first = np.concatenate(([True], key[1:] != key[:-1]))
            group = np.cumsum(first) - 1
            free = np.ones(len(key), bool)
            pairs = []
            for _ in range(LEADERS):
                rows = np.flatnonzero(free)
                if not len(rows):
                    break
                g = group[rows]
                lead = np.concatenate(([True], g[1:] != g[:-1]))
                leader = rows[np.flatnonzero(lead)[np.cumsum(lead) - 1]]
                fit = _fit(similarity, row[:, rows], row[:, leader])
                use = fit & (doc[rows] != doc[leader])
                a, b = leader[use], rows[use]
                pairs.append(np.stack([doc[a], doc[b], _least(similarity, row[0, a], row[0, b])], axis=1))
                free[rows[fit]] = False
            both, met = np.unique(np.concatenate(pairs), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in (both[:, 0], both[:, 1], met.astype(np.int64), both[:, 2])], ["hub", "doc", "met", "least"])

    return run


def _pairs_within(similarity: float):
    """Rows sorted by key and place -> (a, b) of rows of two labels that may be similar.

    Of the keys that a similar pair shares, `least` or more, the first is early in both rows: at least as many less one
    of the row's own come after it. Pairs that share later keys only are none, so those are not looked at. Nor are pairs
    of a crowded key whose marks differ in more bits than similar sets do in shingles.
    """
    apart = 1 - 2 * similarity / (1 + similarity)

    unmarked = bytes(MARKS // 8)

    def distinct(found: list):
        both = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1]))], ["a", "b"])

    def run(batches):
        for key, place, before, own, doc, label, marks in _whole_keys(batches, ("key", "place", "before", "own", "doc_id", "label", "marks")):
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            sizes = np.diff(np.append(first, len(key)))
            mixed = np.repeat(np.minimum.reduceat(label, first) != np.maximum.reduceat(label, first), sizes)
            key, place, before, own, doc, label, marks = (c[mixed] for c in (key, place, before, own, doc, label, marks))
            marks = np.frombuffer(b"".join(unmarked if x is None else x for x in marks), np.uint64).reshape(-1, MARKS // 64)
            row = np.stack([place >> 32, place & 0xFFFFFFFF, before, own])
            n = row[0]
            ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
            left = ends[np.searchsorted(ends, np.arange(len(key)), side="right")] - np.arange(len(key)) - 1 if len(key) else np.zeros(0, int)
            at, k = np.flatnonzero(left > 0), 1
            found, held = [], 0
            while len(at):
                other = at + k
                near = n[at] >= similarity * n[other] - 1e-9  # longer ones follow
                at, other = at[near], other[near]
                least = _least(similarity, n[at], n[other])
                early = (row[2, at] <= row[3, at] - least) & (row[2, other] <= row[3, other] - least)
                fit = early & (label[at] != label[other]) & (doc[at] != doc[other]) & _fit(similarity, row[:, at], row[:, other])
                a, b = at[fit], other[fit]
                alike = np.bitwise_count(marks[a] ^ marks[b]).sum(axis=1) <= apart * (n[a] + n[b]) + 1e-6
                a, b = a[alike], b[alike]
                if len(a):
                    found.append(np.sort(np.stack([doc[a], doc[b]], axis=1), axis=1))
                    held += len(a)
                    if held > JOIN_PAIRS:
                        yield distinct(found)
                        found, held = [], 0
                k += 1
                at = at[left[at] >= k]
            if held:
                yield distinct(found)

    return run


def _labelled(rows: DataFrame, column: str, roots: DataFrame, label: str) -> DataFrame:
    """rows with the least id of the component of `column` by roots(u, v) as `label`."""
    right = _bounded(roots.select(F.col("u").alias(column), F.col("v").alias(label)))
    return rows.join(right, column, "left").withColumn(label, F.coalesce(label, column))


def _shared_keys(sketches: DataFrame) -> DataFrame:
    """(key, place, doc_id, blocks, crowded, before, own): the heads' shingles that two or more rows hold; place has n and
    the place in the head; own is how many such keys the row has, before how many of them come before this one; blocks is
    over 1 where more than HOT_BLOCK rows hold the key, crowded says whether more than CROWDED do, counted exactly."""
    spark = sketches.sparkSession
    exploded = sketches.select("doc_id", "n", "cold", F.posexplode("head").alias("i", "key"))
    rows = exploded.select("key", (F.shiftleft("n", 32) + F.col("i")).alias("place"), "doc_id", (F.col("i") >= F.col("cold")).alias("hot"))
    # hot keys are known to be shared; only the others, which few rows hold, are dealt out to see whether they are
    cold = rows.where("not hot").drop("hot").repartition(shuffle_partitions(spark), "key").sortWithinPartitions("key").mapInArrow(tidy(_met_keys), "key long, place long, doc_id long")
    met = materialize(cold.unionByName(rows.where("hot").drop("hot")), "shared-keys")
    held = met.groupBy("key").count().where(F.col("count") > min(CROWDED, HOT_BLOCK))
    hot = materialize(held.select("key", F.ceil(F.col("count") / HOT_BLOCK).cast("int").alias("blocks"), (F.col("count") > CROWDED).alias("crowded")), "hot-keys")
    if hot.head(1):
        met = met.join(_bounded(hot), "key", "left").withColumns({"blocks": F.coalesce("blocks", F.lit(1)), "crowded": F.coalesce("crowded", F.lit(False))})
    else:
        met = met.withColumns({"blocks": F.lit(1), "crowded": F.lit(False)})
    each = Window.partitionBy("doc_id", F.shiftright("place", 32))
    before = F.row_number().over(each.orderBy("place")) - 1
    return materialize(met.withColumn("before", before.cast("long")).withColumn("own", F.count("*").over(each)), "ranked-keys")


def _hub_links(docs: DataFrame, shared: DataFrame, similarity: float, words: int) -> DataFrame:
    """(u, v): verified links of documents with one hub each, the most central document that they meet most often."""
    n = shuffle_partitions(docs.sparkSession)
    rows = shared.withColumn("order", -F.col("own") / F.shiftright("place", 32))
    own = F.when(F.col("blocks") > 1, F.xxhash64("key", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))).otherwise(F.col("key"))
    rows = rows.select(own.alias("key"), "order", "place", "before", "own", "doc_id").repartition(n, "key").sortWithinPartitions("key", "order", "doc_id")
    met = rows.mapInArrow(tidy(_stars(similarity)), "hub long, doc long, met long, least long").groupBy("hub", "doc").agg(F.sum("met").alias("met"), F.max("least").alias("least")).where("met >= least")
    best = met.groupBy("doc").agg(F.max(F.struct("met", "hub")).alias("best"))
    tried = best.select(F.least("doc", "best.hub").alias("a"), F.greatest("doc", "best.hub").alias("b")).distinct()
    return _verified(docs, materialize(tried, "hub-pairs"), similarity, words)


def missing_links(docs: DataFrame, heads: DataFrame, known: DataFrame, similarity: float, words: int) -> tuple[DataFrame, DataFrame]:
    """(u, v): the links known(u, v) and verified ones that connect all that links of every similar pair connect; and a
    smaller graph of the same components.

    A set-similarity join that leaves out no pair. First every document tries one hub, so that a large group of near
    copies becomes one component at a cost in proportion to its members. Then all pairs of rows that share an early key
    are met that are of different components still, by their marks too where many rows hold the key, and their heads compared; where many remain, one for each two components is verified first, and
    pairs within the components that result are left out too.
    """
    spark, shared = docs.sparkSession, _shared_keys(heads)
    found = known.unionByName(materialize(_hub_links(docs, shared, similarity, words), "hub-links"))
    roots = components(found)
    rows = _labelled(shared, "doc_id", roots, "label")
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks"))
    paired = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.xxhash64("key", F.least(own, b.cast("long")), F.greatest(own, b.cast("long"))))
    marked = rows.where("crowded").withColumn("n", F.shiftright("place", 32)).join(heads.select("doc_id", "n", "marks"), ["doc_id", "n"])
    rows = rows.where("not crowded").withColumn("marks", F.lit(None).cast("binary")).unionByName(marked.select(*rows.columns, "marks"))
    rows = rows.select(F.explode(F.when(F.col("blocks") > 1, paired).otherwise(F.array("key"))).alias("key"), "place", "before", "own", "doc_id", "label", "marks")
    met = rows.repartition(shuffle_partitions(spark), "key").sortWithinPartitions("key", "place").mapInArrow(tidy(_pairs_within(similarity)), "a long, b long").distinct()
    met = materialize(met, "early-pairs")
    ids = materialize(met.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "early-ids")
    few = materialize(heads.select("doc_id", "n", "head").join(_bounded(ids), "doc_id", "left_semi"), "candidate-heads")
    end = lambda c, n, x: few.select(F.col("doc_id").alias(c), F.col("n").alias(n), F.col("head").alias(x))
    share = similarity / (1 + similarity)
    least = F.ceil(share * (F.col("m") + F.col("n")) - 1e-6 - (F.ceil(similarity * F.greatest("m", "n") - 1e-9) - 1))
    pairs = met.join(end("a", "m", "x"), "a").join(end("b", "n", "y"), "b").where(F.size(F.array_intersect("x", "y")) >= least)
    pairs = materialize(pairs.select("a", "b").distinct(), "join-pairs")
    at_once = max(VERIFY_PAIRS, docs.count() // 10)
    for _ in range(THIN_ROUNDS):
        if pairs.count() <= at_once:
            break
        sides = _labelled(_labelled(pairs, "a", roots, "la"), "b", roots, "lb")
        first = F.min(F.struct("a", "b")).alias("p")
        # each component's link to the least one it may belong to: rows in proportion to components
        ends = sides.select("a", "b", F.least("la", "lb").alias("x"), F.greatest("la", "lb").alias("y"))
        tried = materialize(ends.groupBy("y").agg(F.min(F.struct("x", "a", "b")).alias("q")).select(F.struct("q.a", "q.b").alias("p")).unionByName(ends.groupBy("x").agg(first).select("p")).select("p.a", "p.b").distinct(), "join-tried")
        more = materialize(_verified(docs, tried, similarity, words), "join-found")
        found, roots = found.unionByName(more), components(roots.unionByName(more))
        left = _labelled(_labelled(pairs.join(tried, ["a", "b"], "left_anti"), "a", roots, "la"), "b", roots, "lb")
        pairs = materialize(left.where("la <> lb").select("a", "b"), "join-pairs")
    last = materialize(_verified(docs, pairs, similarity, words), "last-links")
    return found.unionByName(last), roots.unionByName(last)


def similar_links(docs: DataFrame, similarity: float = 0.8, words: int = 5, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(u, v): links between rows of docs(doc_id, text), ids not null, that connect whatever the links known(u, v) and the
    pairs of texts connect whose sets of `words`-word shingles have the given Jaccard similarity or more; all but the known
    ones are verified. And a smaller graph of the same components. Texts without words have no links. Equal sets are linked by their 128-bit keys and go on as one.
    """
    sketches = materialize(_sketches(docs, _hot_shingles(docs, words), similarity, words).where("n > 0"), "sketches")
    equal = sketches.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    same = materialize(sketches.join(equal, ["set_a", "set_b"]).where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"), "set_a", "set_b").distinct(), "equal-sets")
    one = sketches.join(_bounded(same.select(F.col("u").alias("doc_id"), "set_a", "set_b")), ["doc_id", "set_a", "set_b"], "left_anti")
    first = same.select("u", "v")
    return missing_links(docs, one, first if known is None else first.unionByName(known), similarity, words)


def near_links(docs: DataFrame, radius: int = 3, width: int = 3, group_cap: int = 20000) -> DataFrame:
    """(u, v): links of documents, ids not null, that connect what near_duplicates() puts in one component."""
    prints = materialize(fingerprints(docs, width), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "nodes")
    same = prints.join(nodes.where("n > 1").select("fp", "rep"), "fp").where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    of = lambda end: nodes.select(F.col("fp").alias(end), F.col("rep").alias(f"rep_{end}"))
    near = links(nodes.select("fp"), radius, group_cap).join(of("u"), "u").join(of("v"), "v")
    return same.unionByName(near.select(F.col("rep_u").alias("u"), F.col("rep_v").alias("v")))


def keep_one(docs: DataFrame, radius: int = 3, similarity: float | None = 0.8) -> DataFrame:
    """docs with one document of each group left: that with the smallest doc_id (ties: the smallest text, then any).

    A group is what the links of near_duplicates() and those of similar_links() connect together (the former alone with
    similarity None). Rows without a doc_id count as larger than all others and are told apart by their text.
    """
    own = "tempora_sid"
    nameless = F.lit(NO_ID) + F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit(NO_ID - 1))
    named = docs.withColumn(own, F.coalesce(F.col("doc_id").cast("long"), nameless))
    plain = named.select(F.col(own).alias("doc_id"), F.col("text").cast("string").alias("text"))
    with scratch(docs.sparkSession) as keep:
        found = materialize(near_links(plain, radius), "near-links")
        if similarity is not None:
            found = similar_links(plain, similarity, known=found)[1]
        gone = keep(components(found)).select(F.col("u").alias(own))
    kept = named.join(_bounded(gone), own, "left_anti")
    repeated = named.groupBy(own).count().where("count > 1")
    if repeated.head(1):
        rank = F.row_number().over(Window.partitionBy(own).orderBy("text"))
        kept = kept.withColumn("tempora_rank", rank).where("tempora_rank = 1").drop("tempora_rank")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(load(spark, sf_dir, "documents"), radius=3, width=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
