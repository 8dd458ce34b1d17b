"""Whole results against plain Python: fingerprints and their likeness, mixing, and what near-dedup keeps."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tempora.llm import katz, merkle, mixing, simhash
from tempora.llm.common import load, materialize, release, scratch

SF = "/root/testdata/sf0.01"


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def slow_fingerprint(t):
    parts, sections = [], []
    for s in re.split(merkle._SECTION, t):
        paragraphs = [[sha(m.group()) for m in re.finditer(merkle._PHRASE.replace("(?s)", ""), line, re.S)] for line in re.split(r"(?<=\n)", s)]
        sections.append(sha(",".join(sha(",".join(p)) for p in paragraphs)))
        codes = [base64.b64encode(b"".join(bytes.fromhex(x)[:3] for x in p)).decode() for p in paragraphs]
        parts.append((sections[-1][:12], codes))
    leaves = {c[i : i + 4] for _, codes in parts for c in codes for i in range(0, len(c), 4)}
    return sha(",".join(sections)) + "|" + "|".join(f"{d}:{','.join(codes)}" for d, codes in parts), leaves


def likeness(a, b):
    if a[0][:64] == b[0][:64]:
        return 1.0
    return 2 * len(a[1] & b[1]) / (len(a[1]) + len(b[1])) if a[1] or b[1] else 0.0


def test_fingerprints(odd):
    docs = [(r.doc_id, r.text or "") for r in odd.select("doc_id", "text").collect()]
    docs.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    expected = Counter()
    for i, (d, t) in enumerate(docs):
        other = docs[(i + 1) % len(docs)][1]
        edited = t[: len(t) - len(t) // 4] + other[: len(t) // 4]
        a, b, c = map(slow_fingerprint, (t, edited, other))
        expected[d, len(t), sha(edited), a[0], b[0], round(likeness(a, b), 9), round(likeness(a, c), 9)] += 1
    got = Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in merkle.compared(odd).collect())
    assert got == expected


def test_mixing(spark):
    """Weights, probabilities and draws of every document, raked anew from its own columns; topics by hand."""
    docs = load(spark, SF, "documents")
    u = {r.doc_id: r.u for r in docs.select("doc_id", mixing._draw().alias("u")).collect()}
    got = mixing.op6(spark, SF).collect()
    cells = Counter()
    for r in got:
        cells[r.source, r.lang, r.topic] += r.tokens
    total = sum(cells.values())
    w = {c: n / total for c, n in cells.items()}
    targets = []
    for i, name in enumerate(mixing.DIMENSIONS):
        held = defaultdict(float)
        for c, n in cells.items():
            held[c[i]] += n
        rare = {v for v, n in held.items() if n < mixing.RARE * total}
        mass = sum(n ** mixing.ALPHAS[name] for v, n in held.items() if v not in rare)
        left = 1 - sum(held[v] for v in rare) / total
        targets.append({v: n / total if v in rare else n ** mixing.ALPHAS[name] / mass * left for v, n in held.items()})
    for _ in range(200):
        for i in range(3):
            now = defaultdict(float)
            for c, x in w.items():
                now[c[i]] += x
            w = {c: x * targets[i][c[i]] / now[c[i]] if now[c[i]] else 0.0 for c, x in w.items()}
    factor = {c: w[c] * total / n if n else 0.0 for c, n in cells.items()}
    bound = 1.0
    for i in range(3):
        held, now = defaultdict(float), defaultdict(float)
        for c, n in cells.items():
            held[c[i]] += n / total
            now[c[i]] += w[c]
        bound *= max(now[v] / held[v] for v in held if held[v])
    most = min(max(factor.values()), bound)
    for r in got:
        c = r.source, r.lang, r.topic
        assert r.weight == pytest.approx(factor[c], rel=1e-3, abs=1e-6)
        assert r.probability == pytest.approx(min(1.0, factor[c] / most), rel=2e-3, abs=1e-6)
        assert r.sampled == (u[r.doc_id] < r.probability)
    topics = mixing.fit_topics(docs)
    of = {r.doc_id: r.topic for r in got}
    assert 2 < len(set(of.values())) <= mixing.TOPICS + 1
    for r in docs.where("doc_id % 25 = 0").collect():
        counts = np.zeros(mixing.WORD_BUCKETS)
        words = (r.text or "").encode().lower().split()
        for x in words:
            counts[mixing._Buckets()[x]] += 1
        x = np.sqrt(counts / max(1, len(words))) - topics.means.get(r.lang, topics.means[None])
        far = [((x - c) ** 2).sum() for c in topics.centres]
        assert of[r.doc_id] == "none" if not words else far[int(of[r.doc_id][5:])] == pytest.approx(min(far), abs=1e-5)


def test_topics_are_fitted_on_every_document(spark):
    """Means and centres are those of all 9000 documents, each centre the mean of those nearest to it, however rows are dealt."""
    rng = np.random.default_rng(5)
    vocabulary = [[f"w{k}x{i}" for i in range(40)] for k in range(5)]
    made = [(i, " ".join(rng.choice(vocabulary[i % 5], 12)), ["en", "de", None, "rare"][3 if i % 900 == 0 else i % 3], "web", 0) for i in range(9000)]
    docs = spark.createDataFrame([*made, (9000, None, "en", "web", 0), (9001, " ", "en", "web", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    topics = mixing.fit_topics(docs.coalesce(1))
    grid = lambda x: np.rint(x * mixing.GRID) / mixing.GRID
    x = mixing.word_shares([m[1].encode() for m in made], mixing._Buckets())[1] / mixing.GRID
    langs = np.array([str(m[2]) for m in made])
    means = {None: grid(x.mean(0)), "de": grid(x[langs == "de"].mean(0)), "en": grid(x[langs == "en"].mean(0))}
    assert topics.means.keys() == means.keys() and all((topics.means[k] == means[k]).all() for k in means)
    left = x - np.stack([means.get(v, means[None]) for v in langs])
    near = ((left[:, None] - topics.centres) ** 2).sum(2).argmin(1)
    assert len(topics.centres) == mixing.TOPICS
    assert all(np.abs(topics.centres[k] - left[near == k].mean(0)).max() < 0.02 for k in range(mixing.TOPICS))
    assert len({(i % 5, k) for i, k in enumerate(near.tolist())}) == mixing.TOPICS  # no topic has two vocabularies
    again = mixing.fit_topics(docs.orderBy(F.rand(3)).repartition(7))
    assert (again.centres == topics.centres).all() and all((again.means[k] == means[k]).all() for k in means)


def test_near_dedup_keeps_one_of_each_group(spark):
    """Every pair of texts with a Jaccard similarity of 0.8 or more, and every link of fingerprints, is in one group."""
    docs = load(spark, SF, "documents")
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    label = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    groups = defaultdict(set)
    for d, c in label.items():
        groups[c].add(d)

    def join(a, b):
        x, y = sorted((label[a], label[b]))
        if x != y:
            for d in groups.pop(y):
                label[d] = x
                groups[x].add(d)

    sets, holders = {}, defaultdict(list)
    for d, t in text.items():
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t).split()
        sets[d] = frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
        for s in sets[d]:
            holders[s].append(d)
    tried = set()
    for d, s in sets.items():
        met = Counter(o for x in s for o in holders[x] if o < d)
        for o, n in met.items():
            if n >= 0.8 * (len(s) + len(sets[o]) - n):
                join(d, o)
                tried.add((o, d))
    assert len(tried) > 20 and kept == {min(g) for g in groups.values()}


def test_ngram_table(spark):
    """The stored n-grams are the learned ones with their discounted counts, each in the shard of its key's range."""
    data = [(i, f"a b c{i % 7} a") for i in range(40)]
    _, levels, counts, weights = katz.fitted(spark.createDataFrame(data, "doc_id long, text string").repartition(3), 50, 200)
    one, two = Counter(), Counter()
    for i, t in data:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            w = [xxhash.xxh64_intdigest(x) for x in t.encode().split()] + [int(katz.END)]
            one.update(w)
            two.update(katz.pair_keys(np.array([int(katz.START), *w[:-1]], np.uint64), np.array(w, np.uint64)).tolist())
    rows = katz.ngram_table(spark, counts, levels).collect()
    assert len({(r.kind, r.key) for r in rows}) == len(rows)
    for kind, n, d in ((katz.WORDS, one, levels.d_word), (katz.PAIRS, two, levels.d_pair)):
        got = {r.key & (2**64 - 1): r.value for r in rows if r.kind == kind}
        assert got == pytest.approx({k: c * (d[c] if c <= katz.TURING else 1.0) for k, c in n.items()})
    at = sorted((r.kind, r.key & (2**64 - 1), r.shard) for r in rows)
    assert all(a[0] != b[0] or a[2] <= b[2] for a, b in zip(at, at[1:]))
    assert {r.kind for r in katz.ngram_table(spark, weights, levels).collect()} == {katz.CONTEXTS}


def test_cuts():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**64, 500, np.uint64))
    for shards in (1, 4, 64, 1 << 20):
        of, at = katz._cuts(keys, shards)
        assert at[0] == 0 and at[-1] == len(keys) and len(at) == len(of) + 1 <= len(keys) + 1
        for s, a, b in zip(of, at, at[1:]):
            assert {int(k) * shards >> 64 for k in keys[a:b]} == {s}


def test_scratch_tables_go(spark):
    with scratch(spark) as keep:
        gone, kept = materialize(spark.range(5).toDF("x"), "gone"), keep(materialize(spark.range(3).toDF("x"), "kept"))
    assert kept.count() == 3
    with pytest.raises(Exception, match="not exist|No such file|NOT_EXIST|FILE_NOT"):
        spark.read.schema("x long").parquet(gone.tempora_path).count()
    release(kept)
