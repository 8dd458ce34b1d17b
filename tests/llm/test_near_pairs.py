"""Pairs of near copies that are just not similar: most go before they are listed, and no similar pair does."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from tempora.llm import simhash


def shingles(text):
    w = text.split()
    return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def near_copies(n, edits, rng):
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(n):
        words = list(base)
        for at in rng.sample(range(5, 145), edits):
            words[at] = f"x{i}at{at}"
        texts.append(" ".join(words))
    return texts


def test_marks_bound_differences():
    rng = np.random.default_rng(3)
    for n in (0, 1, 40, 3000):
        a = np.unique(rng.integers(0, 2**64, n, np.uint64))
        b = np.concatenate([a[n // 4 :], rng.integers(0, 2**64, n // 3, np.uint64)])
        apart = sum(x.bit_count() for x in (p ^ q for p, q in zip(simhash._marks(a), simhash._marks(b))))
        assert len(simhash._marks(a)) * 8 == simhash.MARKS
        assert apart <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("crowded", [64, 2, 1 << 30])
def test_pairs_of_near_copies(spark, monkeypatch, crowded):
    """Two edits each: pairs have a similarity of some 0.77, or more where edits stand close together."""
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    texts = near_copies(150, 2, random.Random(7)) + near_copies(20, 4, random.Random(8))
    listed = {}
    write = simhash.materialize

    def told(df, name):
        out = write(df, name)
        listed[name] = max(listed.get(name, 0), out.count())
        return out

    monkeypatch.setattr(simhash, "materialize", told)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    links, _ = simhash.similar_links(docs)
    found = {(r.u, r.v) for r in links.collect()}
    sets = [shingles(t) for t in texts]
    similar = {(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert {tuple(sorted(x)) for x in found} <= similar

    def groups(pairs):
        label = list(range(len(texts)))
        for _ in label:
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
        return label

    assert len(similar) > 100 and groups(found) == groups(similar)
    if crowded < 100:
        assert listed["early-pairs"] < 4 * len(similar)
