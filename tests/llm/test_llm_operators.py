"""Each operator against brute force, on odd rows and on the smallest tables."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tempora.llm import katz, line_dedup, merkle, mixing, packing, pii, quality, simhash, topk, warc
from tempora.llm.common import load
from tempora.llm.components import components

SF = "/root/testdata/sf0.001"


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


def sets(pairs):
    groups = defaultdict(set)
    for k, v in pairs:
        groups[v].add(k)
    return sorted(map(sorted, groups.values()))


def lower(t):
    return re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), t or "")


def words(t):
    return [w for w in re.split("[\x20\x09-\x0d]+", lower(t)) if w]


# 7


def kept_lines(docs, least=10):
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    n = Counter(k for _, t in docs for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if n[key(x)] < least]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("bytes_", [64 << 20, -1])
@pytest.mark.parametrize("least", [2, 10])
def test_lines(spark, odd, least, bytes_):
    state = line_dedup.build_state(odd, least)
    got = line_dedup.drop_frequent_lines(odd, state, bytes_)
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, got.select("doc_id", "n_lines", "n_dropped", "kept_text").collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1:])) == sorted(kept_lines(texts(odd), least), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))
    assert got.columns[: len(odd.columns)] == odd.columns and key


@pytest.mark.parametrize("bytes_", [64 << 20, -1])
def test_lines_keep_all_columns(spark, bytes_):
    """Columns of any name come out, also those named like added or inner ones; a hot line is asked in parts."""
    data = [(i, "Same line\nown %d" % (i // 2), f"g{i}", f"k{i}", 7, "x", i) for i in range(40)]
    df = spark.createDataFrame(data, "doc_id long, text string, gone string, text_key string, n_lines int, n_lines_in string, shard int")
    got = line_dedup.drop_frequent_lines(df, line_dedup.build_state(df, 10), bytes_, part_rows=7)
    assert got.columns == ["doc_id", "text", "gone", "text_key", "n_lines_in_in", "n_lines_in", "shard", "kept_text", "n_lines", "n_dropped"]
    assert sorted(map(tuple, got.collect())) == sorted((*r, r[1].split("\n")[1], 2, 1) for r in data)


def state_of(state):
    return rows(state.refcounts, "shard", "key", "n")


def test_lines_are_reversible(spark, odd):
    first = line_dedup.build_state(odd, 2)
    more = spark.createDataFrame([(900 + i, f"One line\nfresh {i % 2}\nOnly {i}") for i in range(6)], "doc_id long, text string")
    grown = line_dedup.update_state(first, inserted=more)
    both = texts(odd) + texts(more)
    everything = spark.createDataFrame(both, "doc_id long, text string")
    assert sorted(n for *_, n in state_of(grown)) == sorted(n for *_, n in state_of(line_dedup.build_state(everything, 2)))
    got = line_dedup.drop_frequent_lines(everything, grown)
    assert sorted((r.doc_id or 0, r.kept_text) for r in got.collect()) == sorted((d or 0, k) for d, _, _, k in kept_lines(both, 2))
    back = line_dedup.update_state(grown, deleted=more)
    assert state_of(back) == state_of(first)
    again = line_dedup.drop_frequent_lines(odd, back)
    assert sorted((r.doc_id or 0, r.kept_text) for r in again.collect()) == sorted((d or 0, k) for d, _, _, k in kept_lines(texts(odd), 2))


def test_cuckoo_filter():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 2**64, (5000, 2), np.uint64)
    f = line_dedup._full_filter(keys)
    assert f.contains(keys).all()
    assert f.contains(rng.integers(0, 2**64, (20000, 2), np.uint64)).mean() < 0.01
    assert all(f.delete(k) for k in keys[:2500]) and f.contains(keys[2500:]).all()
    assert f.contains(keys[:2500]).mean() < 0.01


def test_lines_of_nothing(none):
    state = line_dedup.build_state(none)
    assert line_dedup.drop_frequent_lines(none, state).count() == 0


# 4


def slow_fingerprint(t):
    w = words(t)
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    n = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            n[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * n[b] > len(shingles))


def linked(fps, radius=3):
    label = list(range(len(fps)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    a = np.array(fps, np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= radius):
            x, y = find(i), find(int(j))
            label[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(fps))]


def test_simhash(odd):
    docs = texts(odd)
    fps = [slow_fingerprint(t) for _, t in docs]
    label = linked(fps)
    least = {}
    for (d, _), c in zip(docs, label):
        if d is not None:
            least[c] = min(least.get(c, d), d)
    expected = Counter((d, f, least.get(c)) for (d, _), f, c in zip(docs, fps, label))
    got = Counter((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(odd).collect())
    assert got == expected


@pytest.mark.parametrize("cap", [20000, 3, 1])
@pytest.mark.parametrize("thresholds", [None, [1, 1], [0, 1, 0], [1, 0, 0], [2, 0], [2, -1, 0], [0, 0, 0, 0]])
def test_links(spark, monkeypatch, cap, thresholds):
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 2**63, 12, np.uint64)
    near = [c ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for c in centres for k in (1, 2, 3, 4, 5) for _ in range(2)]
    fps = np.unique(np.concatenate([centres, np.array(near, np.uint64)]))
    if thresholds:
        m = len(thresholds)
        monkeypatch.setattr(simhash, "plan", lambda n, c, p, g, r: (g[m], thresholds))
    nodes = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    found = {r.u: r.v for r in components(simhash.links(nodes, 3, cap)).collect()}
    got = [found.get(int(x), int(x)) for x in fps.view(np.int64)]
    assert sets(enumerate(got)) == sets(enumerate(linked(fps)))


def test_plan_allots_by_cost():
    costs = [{-1: 0, 0: 10, 1: 50}, {-1: 0, 0: 100, 1: 900}, {-1: 0, 0: 10, 1: 60}]
    assert simhash.allot(costs, 0) == (50 + 10 + 0, [1, -1, 0])
    assert simhash.allot(costs, 1)[1] in ([1, -1, 1],)


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(1000, 1000 + i) for i in range(300)] + [(2000 + i, 2001 + i) for i in range(60)]
    edges = spark.createDataFrame([*pairs, (5, 5), (None, 7)], "u long, v long")
    found = {r.u: r.v for r in components(edges).collect()}
    nodes = sorted({x for p in pairs for x in p})
    label = {x: x for x in nodes}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        label[max(x, y)] = min(x, y)
    assert {x: found.get(x, x) for x in nodes} == {x: find(x) for x in nodes}


def test_keep_one(odd, none):
    kept = texts(simhash.keep_one(odd, similarity=None))
    docs = texts(odd)
    label = linked([slow_fingerprint(t) for _, t in docs])
    groups = defaultdict(list)
    for (d, t), c in zip(docs, label):
        groups[c].append((math.inf if d is None else d, t or ""))
    assert sorted((math.inf if d is None else d, t or "") for d, t in kept) == sorted(min(g) for g in groups.values())
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


def jaccard(a, b):
    sets_ = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := words(t)) else set() for t in (a, b)]
    return len(sets_[0] & sets_[1]) / max(1, len(sets_[0] | sets_[1]))


def test_similar_texts_go(spark, odd):
    """Of texts with a word or two changed one stays; whatever goes is similar to another text; others stay."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("aeioulnrst") for _ in range(6)) for _ in range(3000)]
    data, groups = [], []
    for g in range(12):
        text = [rng.choice(vocabulary) for _ in range(200 + 50 * g)]
        members = [text]
        for _ in range(3):
            copy = list(text)
            for _ in range(1 + g % 2):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            members.append(copy)
        groups.append(range(len(data), len(data) + 4))
        data += [(len(data) + i, " ".join(m)) for i, m in enumerate(members)]
    alone = [(1000 + i, " ".join(rng.choice(vocabulary) for _ in range(150))) for i in range(30)]
    df = spark.createDataFrame(data + alone, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.keep_one(df).collect()}
    assert kept >= {d for d, _ in alone} and all(len(kept & set(g)) >= 1 for g in groups)
    assert sum(len(kept & set(g)) for g in groups) <= len(groups) + 2
    of = dict(data)
    found = [(r.u, r.v) for r in simhash.similar_links(df)[0].collect()]
    assert found and all(jaccard(of[a], of[b]) >= 0.8 for a, b in found)
    out = texts(simhash.keep_one(odd))
    assert set(out) <= set(texts(simhash.keep_one(odd, similarity=None))) and simhash.keep_one(odd).columns == odd.columns


def test_all_similar_texts_go(spark, monkeypatch):
    """Kept ids against brute force, with blocks replaced and text appended; hot shingles in blocks, pairs thinned."""
    rng = random.Random(17)
    vocabulary = ["".join(rng.choice("aeioulnrst") for _ in range(6)) for _ in range(3000)]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    data = []
    for _ in range(15):
        text = draw(400)
        at = rng.randrange(300)
        scattered = list(text)
        for _ in range(8):
            scattered[rng.randrange(400)] = rng.choice(vocabulary)
        data += [text, text[:at] + draw(40) + text[at + 40 :], text[:at] + draw(20) + text[at + 20 :], text + draw(60), text + draw(85), text + draw(140), scattered]
    common = draw(30)
    data += [common + draw(rng.randrange(3, 60)) for _ in range(60)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(data)], "doc_id long, text string")
    of = dict(texts(df))
    first = sorted(r.doc_id for r in simhash.near_duplicates(df).collect() if r.doc_id == r.component_id)
    label = {d: d for d in first}
    for i, a in enumerate(first):
        for b in first[i + 1 :]:
            if label[a] != label[b] and jaccard(of[a], of[b]) >= 0.8:
                x, y = sorted((label[a], label[b]))
                label = {d: x if c == y else c for d, c in label.items()}
    want = set(label.values())
    assert {r.doc_id for r in simhash.keep_one(df).collect()} == want
    for name, value in {"SAMPLE_DOCS": 40, "HOT": 3, "HOT_BLOCK": 10, "JOIN_ROWS": 50, "JOIN_PAIRS": 5, "VERIFY_PAIRS": 0, "THIN_ROUNDS": 2}.items():
        monkeypatch.setattr(simhash, name, value)
    assert {r.doc_id for r in simhash.keep_one(df).collect()} == want


# 9


def test_quality(spark):
    docs, labels = load(spark, SF.replace("0.001", "0.01"), "documents"), load(spark, SF.replace("0.001", "0.01"), "labels")
    got = {r.doc_id: r for r in quality.op9(spark, SF.replace("0.001", "0.01")).collect()}
    marked = [(r.doc_id, r.quality) for r in labels.collect()]
    held = [(d, q) for d, q in marked if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, _ in marked)
    assert np.mean([got[d].predicted == q for d, q in held]) >= 0.95
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())


def test_quality_is_the_discriminant():
    rng = np.random.default_rng(1)
    d = len(quality.STATISTICS)
    x0, x1 = rng.normal(0, 1, (300, d)), rng.normal(0.5, 2, (500, d))
    factors = [np.linalg.cholesky(np.cov(x.T)) for x in (x0, x1)]
    m = quality.Model(np.zeros(d), np.ones(d), np.array([0.4, 0.6]), np.array([x0.mean(0), x1.mean(0)]), np.array(factors), np.array([2 * np.log(np.diag(f)).sum() for f in factors]))
    z = rng.normal(0, 1, (20, d))

    def density(v, x):
        c = np.cov(x.T)
        return -0.5 * (v - x.mean(0)) @ np.linalg.inv(c) @ (v - x.mean(0)) - 0.5 * np.linalg.slogdet(c)[1]

    assert m.score(z) == pytest.approx([1 / (1 + math.exp(math.log(0.4) - math.log(0.6) + density(v, x0) - density(v, x1))) for v in z])


def test_quality_of_odd_rows(spark, odd, none):
    labels = load(spark, SF, "labels")
    stats = quality.statistics(odd)
    model = quality.fit(quality.statistics(load(spark, SF, "documents")), labels)
    scores = quality.score(stats, model).collect()
    assert len(scores) == odd.count() and all(0 <= r.score <= 1 for r in scores)
    kept = quality.keep_good(odd, model)
    assert kept.columns == odd.columns and kept.count() == sum(r.score >= 0.3 for r in scores)
    broken = spark.createDataFrame([(None, 1, 0), (4, None, 0), (5, 7, 0)], labels.schema)
    for l in (broken, labels.where("false"), labels.where("quality = 1")):
        alone = quality.fit(quality.statistics(load(spark, SF, "documents")), l)
        assert {r.score for r in quality.score(stats, alone).collect()} == {1.0 if l.where("quality = 1 and doc_id is not null").count() else 0.5}
    assert quality.score(quality.statistics(none), model).count() == 0 and quality.keep_good(none, model).count() == 0


# 6


@pytest.mark.parametrize("here", [50_000, 0])
def test_raking(odd, here):
    small = mixing.with_dimensions(odd)
    cells = [(r.source, r.lang, r.topic, r.tokens, r.w, r.probability) for r in mixing.rake(small, cells_here=here).collect()]
    total = sum(c[3] for c in cells)
    for i, name in enumerate(mixing.DIMENSIONS):
        held, now = Counter(), Counter()
        for c in cells:
            held[c[i]] += c[3]
            now[c[i]] += c[4]
        want = {k: (v / total) ** mixing.ALPHAS[name] for k, v in held.items()}
        for k, v in want.items():
            assert now[k] == pytest.approx(v / sum(want.values()), abs=2e-3)
    assert max(c[5] for c in cells) == pytest.approx(1) and all(0 <= c[5] <= 1 for c in cells)


@pytest.mark.parametrize("here", [50_000, 0])
def test_rare_values_leave_the_rest(spark, here):
    """A document of a rare or null value, alone or in a cell of its own, costs few others, whatever the corpus's size."""
    base = [(s, x, "prose", 1000 * n) for s, x, n in (("web", "en", 600), ("web", "de", 150), ("news", "en", 150), ("news", "de", 100))]
    nested = [("web", "en", "prose", 600_000), ("books", "fr", "prose", 100_000), ("plays", "fr", "prose", 300_000)]

    def kept(data, times=1):
        df = spark.createDataFrame([(*d[:3], d[3] * (times if d[3] > 50 else 1)) for d in data], "source string, lang string, topic string, tokens long")
        cells = mixing.rake(df, cells_here=here).collect()
        assert all(0 <= c.probability <= 1 for c in cells)
        return sum(c.tokens * c.probability for c in cells) / sum(c.tokens for c in cells)

    for more in ([("web", None, "prose", 50)], [("new", "en", "prose", 50)], [(None, None, "caps", 50), ("new", "de", "prose", 50)]):
        for times in (1, 300):
            assert kept(base + more, times) > 0.95 * kept(base)
    assert kept([*nested, ("books", "en", "prose", 50)]) > 0.5


def test_mixing(spark, odd, none):
    tokens = {(r.doc_id, r.tokens) for r in mixing.with_dimensions(odd).collect()}
    assert tokens == {(d, len([w for w in re.split("[\x20\x09-\x0d]+", t or "") if w])) for d, t in texts(odd)}
    kept = mixing.mix(odd)
    assert kept.columns == odd.columns and 0 < kept.count() <= odd.count()
    assert rows(kept, "doc_id", "rank") == rows(mixing.mix(odd), "doc_id", "rank")
    assert mixing.mix(none).count() == 0
    docs = load(spark, SF.replace("0.001", "0.1"), "documents")
    found = mixing.op6(spark, SF.replace("0.001", "0.1"))
    r = found.agg(F.sum("tokens").alias("t"), F.sum(F.col("tokens") * F.col("probability")).alias("e"), F.sum(F.when(F.col("sampled"), F.col("tokens"))).alias("s"), F.count("*").alias("n")).first()
    assert r.n == docs.count() and r.s == pytest.approx(r.e, rel=0.05)


# 2


def test_packing(spark, odd):
    from tokenizers import Tokenizer

    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack_documents(odd).collect()
    expected = Counter()
    for d, t in texts(odd):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)] if len(ids) > 2048 else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            expected[d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048


def test_ids_are_the_tokenizers():
    encoder = packing._encoder("byte_bpe_50k.json")
    assert encoder.merger is not None
    rng, signs = random.Random(1), "ab Zé'sß \t\n\r.,!?123ÅöÑ¿¡«×÷ºª²½\u00a0\u00adſđƒ😀中\u2003'll're've's "
    for _ in range(4000):
        t = "".join(rng.choice(signs) for _ in range(rng.randrange(60)))
        assert encoder.encode(t) == np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def best_fit(lengths, size):
    rooms = []
    for x in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= x]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - x)
        else:
            rooms.append(size - x)
    return len(rooms)


@pytest.mark.parametrize("seed", range(8))
def test_slots_are_best_fit(seed):
    rng = random.Random(seed)
    lengths = [rng.randrange(1, 101) for _ in range(rng.randrange(1, 400))]
    slots = packing.plan_slots(Counter(lengths), 100)
    filled, ranks = defaultdict(list), defaultdict(list)
    for length, first, end, sequence, each, offset in slots:
        ranks[length].append((first, end))
        for r in range(first, end):
            filled[sequence + (r - first) // each].append((offset + (r - first) % each * length, length))
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 100
    assert all(sorted(v)[0][0] == 0 and all(a[1] == b[0] for a, b in zip(sorted(v), sorted(v)[1:])) and max(v)[1] == Counter(lengths)[k] for k, v in ranks.items())
    assert len(filled) == best_fit(lengths, 100)


def test_packing_of_nothing(none):
    assert packing.pack_documents(none).count() == 0


# 3


def test_fingerprints(odd):
    got = defaultdict(list)
    for r in merkle.compared(odd).collect():
        got[r.doc_id].append(r)
    docs = sorted(texts(odd), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    roots = {}
    for i, (d, t) in enumerate(docs):
        t, other = t or "", docs[(i + 1) % len(docs)][1] or ""
        edited = t[: len(t) - len(t) // 4] + other[: len(t) // 4]
        match = [r for r in got[d] if r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()]
        assert match, d
        r = match[0]
        roots.setdefault(t, r.fingerprint)
        assert roots[t] == r.fingerprint and (r.near_edited == 1) == (t == edited) and (r.near_next == 1) == (t == other)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if len(t) > 400 and len(set(t)) > 5 and len(set(t.split())) > 20:
            assert r.near_edited > 0.5
    assert len(set(roots.values())) == len(roots)


def test_fingerprint_tree(spark, none):
    df = spark.createDataFrame([("Hello there.\nA second line\nthird",)], "t string")
    phrases = df.select(merkle.tree(F.col("t")).alias("x")).first().x
    texts_ = [[[m.group() for m in re.finditer(merkle._PHRASE.replace("(?s)", ""), line, re.S)] for line in re.split(r"(?<=\n)", s) if line] for s in re.split(merkle._SECTION, df.first().t)]
    assert "".join(p for s in texts_ for line in s for p in line) == df.first().t
    assert [[[hashlib.sha256(p.encode()).hexdigest() for p in line] for line in s] for s in texts_] == [[list(line) for line in s if line] for s in phrases]
    pair = merkle.with_fingerprint(merkle.with_fingerprint(spark.createDataFrame([("A one.\nB two.\nC three.", "A one.\nB 2.\nC three.")], "a string, b string"), "a", "fa"), "b", "fb")
    r = merkle.edits(pair, "fa", "fb").first()
    assert list(r.only_a) == [1] and list(r.only_b) == [1]
    assert merkle.compared(none).count() == 0
    one = merkle.compared(spark.createDataFrame([(1, "only text here")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_next_rows(spark, ranges):
    rng = random.Random(ranges)
    data = [(rng.randrange(60), f"t{rng.randrange(30)}") for _ in range(100)] + [(None, "n1"), (None, "n2")]
    got = [(r.doc_id, r.text, r.next_text) for r in merkle.with_next(spark.createDataFrame(data, "doc_id long, text string"), ranges).where("end = 0").collect()]
    order = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert Counter(got) == Counter((d, t, order[(i + 1) % len(order)][1]) for i, (d, t) in enumerate(order))


# 8


def test_archives(spark):
    data = [(5, "u5", "same"), (3, "u3", "same"), (4, None, "other"), (6, "u\r\n6", None), (7, "u7", ""), (9, "u9", "é" * 100000), (None, "n", "same"), (3, "u3", "same"), (11, "u11", "solo"), (None, "m", "lost"), (None, "m", "lost")]
    pages = spark.createDataFrame([(*r, i) for i, r in enumerate(data)], "page_id long, url string, html string, path int")
    index = warc.write_archives(pages)
    got = warc.read_records(index).collect()
    assert len(got) == len(data)
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    first = {"same": 3, "other": 4, "": 6, "é" * 100000: 9, "solo": 11, "lost": None}
    seen, expected = set(), Counter()
    for p, _, t in sorted(data, key=lambda r: (r[0] is None, r[0] or 0)):
        t = t or ""
        response = p == first[t] and t not in seen
        seen.add(t) if response else None
        expected[p, len(t.encode()), digest(t), "response" if response else "revisit", None if response else first[t]] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == expected
    assert {bytes(r.payload).decode() for r in got if r.record_type == "response"} == set(first)
    some = warc.read_records(index.where("page_id in (4, 9)")).collect()
    assert sorted((r.page_id, bytes(r.payload).decode()) for r in some) == [(4, "other"), (9, "é" * 100000)]
    short = {(r.page_id, r.record_type) for r in warc.read_records(warc.write_archives(pages, min_bytes=5, archive_bytes=100)).collect()}
    assert (5, "response") in short and (7, "response") in short
    assert warc.read_records(warc.write_archives(pages.where("false"))).count() == 0


def test_archives_are_warc(spark):
    import gzip

    path = warc.write_archives(load(spark, SF, "pages")).first().path
    data = gzip.open(path.removeprefix("file://")).read()
    count = 0
    while data:
        headers = dict(x.split(": ", 1) for x in data.partition(b"\r\n\r\n")[0].decode().split("\r\n")[1:])
        size = data.index(b"\r\n\r\n") + 4 + int(headers["Content-Length"]) + 4
        _, payload = warc.parse(data[:size])
        assert headers["WARC-Type"] == "revisit" or warc.base32_sha1(payload) == headers["WARC-Payload-Digest"][5:]
        data, count = data[size:], count + 1
    assert count


def test_coalesced_ranges():
    assert warc.coalesced([(0, 10), (12, 10), (100, 5), (105, 5)], gap=5, run=50) == [(0, 22, [0, 1]), (100, 10, [2, 3])]
    assert [x[2] for x in warc.coalesced([(0, 10), (10, 10), (20, 10)], gap=5, run=20)] == [[0, 1], [2]]


# 5


@pytest.mark.parametrize("n", [1, 3, 6, 50, 400])
def test_top_k(spark, n):
    rng = np.random.default_rng(n)
    data = [(i, [float(x) for x in rng.choice([-0.5, -0.25, 0, 0.25, 0.7], 6)]) for i in range(n)]
    data += [(1000, None), (1050, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1100, [float("nan")] * 6), (1150, [float("inf")] * 6), (None, [1.0] * 6), (1200, [1.0, 2.0]), (0, data[0][1])]
    df = spark.createDataFrame([(*r, 1) for r in data], "vec_id long, embedding array<float>, score int")
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0).collect()))
    good = [(i, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v in data if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    expected = []
    for q, a in set(good):
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q and len(a) == len(b))[:5]
            expected += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert got == sorted(expected)


def test_top_k_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "VECTORS", 60)
    monkeypatch.setattr(topk, "AT_ONCE", 3)
    e = load(spark, SF, "embeddings")
    small = sorted(map(tuple, topk.op5(spark, SF).collect()))
    monkeypatch.undo()
    assert small == sorted(map(tuple, topk.op5(spark, SF).collect())) and len(small) == 5 * e.where("vec_id % 50 = 0").count()
    assert topk.top_k(e.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_bounds_large_numbers():
    rng = np.random.default_rng(0)
    v = rng.integers(-(2**29), 2**29, (300, 4))
    ids = np.arange(300)
    for i, found, scores in topk.block_top_k(v[:20], ids[:20], v, ids, 5):
        exact = sorted((-sum(int(a) * int(b) for a, b in zip(v[i], w)), j) for j, w in enumerate(v) if j != i)[:5]
        assert [(-int(s), int(j)) for s, j in zip(scores, found)] == exact


# 10


@pytest.mark.parametrize("least", [1, 2])
@pytest.mark.parametrize("chunk", [300, 10**9])
def test_katz(spark, odd, chunk, least, monkeypatch):
    monkeypatch.setattr(katz, "MIN_PAIR", least)
    docs = [(d, t) for d, t in texts(odd)] + [(500 + i, f"of the river {i % 3} of the market") for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = katz.score_texts(df, chunk, 4000).collect()
    token = [[*words(t), "\0end"] for _, t in docs]
    out = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in docs]
    one, two = Counter(), Counter()
    for w, h in zip(token, out):
        if not h:
            one.update(w)
            two.update(zip(["\0start", *w], w))
    n, v = sum(one.values()), len(one)
    counts = lambda c: [sum(x == r for x in c.values()) for r in range(1, 7)]
    d1, d2 = katz.discounts(counts(one)), katz.discounts(counts(two), katz.MIN_PAIR)
    keep = lambda d, c: c * (d[c] if c <= 5 else 1.0)
    z, p0 = sum(keep(d1, c) for c in one.values()), counts(one)[0] / n
    p = lambda w: (1 - p0) * keep(d1, one[w]) / z if w in one else p0
    context = one + Counter({"\0start": one["\0end"]})
    after = defaultdict(list)
    for (a, b), c in two.items():
        if c >= katz.MIN_PAIR:
            after[a].append((b, c))

    def model(a):
        if not after[a]:
            return context[a], 1.0
        seen = sum(keep(d2, c) for _, c in after[a])
        d = context[a] + (context[a] - seen < 1e-6 * context[a])
        return d, (1 - seen / d) / (1 - sum(p(b) for b, _ in after[a]))

    def probability(a, b):
        d, alpha = model(a)
        return keep(d2, two[a, b]) / d if two[a, b] >= katz.MIN_PAIR else alpha * p(b)

    for a in ["\0start", "the", "of", "river", "never"]:
        assert sum(probability(a, b) for b in one) + model(a)[1] * p0 == pytest.approx(1)
    expected = Counter()
    for (d, _), w, h in zip(docs, token, out):
        base = sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w)
        expected[d, h, len(w), sum(x in one for x in w), n, round(base, 5), round(sum(math.log10(probability(a, b)) for a, b in zip(["\0start", *w], w)), 5)] += 1
    close = lambda rows: sorted((str(r[0]), *r[1:5], r[5], r[6]) for r in rows)
    a, b = close(expected.elements()), close(tuple(r) for r in got)
    assert [x[:5] for x in a] == [x[:5] for x in b]
    assert [x[5] for x in a] == pytest.approx([x[5] for x in b], abs=1e-4) and [x[6] for x in a] == pytest.approx([x[6] for x in b], abs=1e-4)


def test_katz_of_nothing(spark, none):
    assert katz.score_texts(none).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = katz.score_texts(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert [(x.held_out, x.n_tokens, x.n_known, x.train_tokens, x.base_score, x.score) for x in r] == [(True, 3, 0, 0, 0.0, 0.0)]


def test_katz_beats_the_base(spark):
    held = katz.op10(spark, SF).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert held.s > held.b


def test_katz_discounts():
    d = katz.discounts([100, 40, 20, 12, 8, 6])
    assert d[0] == 0 and all(0 < x < 1 for x in d[1:])
    common = 6 * 6 / 100
    assert d[1] == pytest.approx((2 * 40 / 100 - common) / (1 - common))
    assert katz.discounts([0, 0, 0, 0, 0, 0])[1:].tolist() == [0.5, 0.75, 2.5 / 3, 3.5 / 4, 0.9]
    a = np.unique(np.random.default_rng(0).integers(0, 2**64, 1000, np.uint64))
    assert (katz._expand_keys(katz._squeeze_keys(a)) == a).all() and len(katz._expand(katz._squeeze(np.zeros(0)), np.float64)) == 0


# 1

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def slow_spans(t):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, t):
            digits = [int(c) for c in m.group() if c.isdigit()]
            check = sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(reversed(digits))) % 10 == 0
            if k == 0 or k == 1 and all(int(x) <= 255 for x in m.group().split(".")) or k == 2 and 13 <= len(digits) <= 19 and check or k == 3 and 9 <= len(digits) <= 15:
                out.append((k, *m.span()))
    return out


def test_base_spans():
    rng = random.Random(0)
    parts = [*"123.- +()@ab%é", ".com", "4111111111111111", "x@y.z", "255.", "1.2.3.4", "+1 (269) 555-3296"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(25)))
        assert pii.base_spans(t)[0] == slow_spans(t), t
    for t in ("1" * 100000, "@" * 100000, "a" * 100000 + "@", "+1" * 50000, "1." * 50000, "a@" * 50000):
        pii.base_spans(t)
        pii.tokens(t)


@pytest.fixture(scope="module")
def field(spark):
    return pii.fit(load(spark, SF.replace("0.001", "0.1"), "documents"))


def test_field_adds_what_ran_together(field):
    t = "Call +1 (269) 555-3296 4524132264652876 now.\nIP 27.65.93.188 4451718024887799 and Version 2.0. again (269) 555-3296"
    base, every = pii.find([t], field)[0]
    found = [(pii.KINDS[k], t[a:b]) for k, a, b in every]
    assert set(base) <= set(every)
    assert ("phone", "+1 (269) 555-3296") in found and ("card", "4524132264652876") in found and ("card", "4451718024887799") in found
    assert not any("2.0" in s for _, s in found)


def test_personal_data(spark, odd, none, field):
    got = pii.personal_data(odd, field).collect()
    clear = lambda spans: ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans)
    expected = Counter()
    for d, t in texts(odd):
        s = slow_spans(t or "")
        expected[d, *(sum(x[0] == k for x in s) for k in range(4)), hashlib.sha256(clear(s).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == expected
    assert pii.personal_data(none, field).count() == 0 and pii.fit(none) is None
    assert all(r.spans == "" or r.n_email + r.n_ip + r.n_card + r.n_phone or r.doc_id == 14 for r in pii.personal_data(odd, None).collect())


def test_messages_are_exact_on_chains(field):
    """Without cycles, loopy message passing gives the marginals that summing over all labellings gives."""
    rng = np.random.default_rng(0)
    unary = rng.normal(0, 1, (3, pii.LABELS))
    chain, skip = np.array([[0, 1]]), np.array([[1, 2]])
    joint = np.exp(unary[0][:, None, None] + unary[1][None, :, None] + unary[2][None, None, :] + field.chain[:, :, None] + field.skip[None, :, :])
    joint /= joint.sum()
    got = field.marginals(unary, chain, skip, 200)
    assert got[0] == pytest.approx(joint.sum((1, 2)), abs=1e-3) and got[1] == pytest.approx(joint.sum((0, 2)), abs=1e-3) and got[2] == pytest.approx(joint.sum((0, 1)), abs=1e-3)


def test_arrow_bytes():
    from tempora.llm.common import as_bytes

    assert as_bytes(pa.array(["é", None, ""])) == ["é".encode(), None, b""]
