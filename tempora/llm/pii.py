"""Operator 1, personal data by a skip-chain conditional random field.

Base patterns give e-mail addresses, IP addresses, card and phone numbers, each kind leftmost and non-overlapping, with
failing matches dropped. They miss data that runs into its neighbours (a card number right after a phone number is
one long match of neither kind), other writings of the same number, and secrets. The field finds these: its nodes are
the tokens that hold a digit or an at sign, with labels outside, begin and inside of each kind; neighbouring tokens share a
transition, and a token is also tied to the next one of the same document that has the same address or key, or the same
last seven digits (a skip edge), so labels of repeated or similar data agree. Tokens without digits and at signs are
outside by definition; clamped, they only add to their neighbours' potentials. Loopy message passing over all edges
gives marginals; each document settles by its own messages.

Weights are learned by pseudo-likelihood from at most twice `fit_documents` documents drawn by hash and MOST_NODES
nodes of each (the bounds of the sample). Labels are those of the base spans and, for secrets, of keys that are assigned
to a name; tokens of failing matches take part without a label. Each document is learned from twice: as it is, and with
its data mentioned again in other writings or without features, so the weights of edges are learned where only they tell.
A span of the field is added if it overlaps no base span and either has its kind's form or is surely of its kind and
tied, over skip edges, to data that has.

Nulls and odd rows: a null text is an empty one and has no spans; repeated rows give repeated results; a null doc_id is
kept; without anything to learn from the base spans stand alone; an empty table gives an empty result; other columns
are not read; a very long text takes memory in proportion to its tokens with digits.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm.common import load, whole_texts

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = 4  # the kinds that base patterns find
LABELS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
FIT_DOCUMENTS, MOST_NODES = 4000, 400
SURE = 0.5
REPEATS_SURE = 0.8
ROWS = 1 << 16  # nodes or edges worked on at a time

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Starting only where a run of digits starts finds the same matches as trying every place, in linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"""[^\s"'=<>{}\[\]|,;]+""")
_DIGITS = re.compile(r"[0-9]+")
_LETTERS = re.compile(r"[^\W\d_]+")
_SECRET = re.compile(r"[A-Za-z0-9+/_-]{20,}+={0,2}")
_AROUND = ".,;:!?\"'|#$%&*[]{}<>="

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(_DIGITS.findall(s))


def well_formed(kind: int, s: str) -> bool:
    """The check that a base match of the kind must pass."""
    if kind == 1:
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))
    if kind == 4:
        return bool(_SECRET.fullmatch(s)) and len(_only_digits(s)) >= 4 and sum(map(len, _LETTERS.findall(s))) >= 4 and len(set(s)) >= 8
    digits = _only_digits(s)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == 0 or 9 <= len(digits) <= 15


def emails(text: str) -> list[tuple[int, int]]:
    found, end, last, at = [], 0, 0, text.find("@")
    while at >= 0:
        part = text[max(end, last) : at]
        local = len(part) - len(part.rstrip(_LOCAL))
        last = at + 1
        m = _DOMAIN.match(text, at + 1) if local else None
        if m:
            found.append((at - local, m.end()))
            end = last = m.end()
        at = text.find("@", last)
    return found


def base_spans(text: str) -> tuple[list[Span], list[tuple[int, int]]]:
    """The base spans by kind, then start; and the matches that failed their check."""
    spans: list[Span] = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    failed = []
    for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
        for m in pattern.finditer(text):
            if well_formed(kind, m.group()):
                spans.append((kind, *m.span()))
            elif kind != 2 or len(_only_digits(m.group())) >= 13:
                failed.append(m.span())
    return spans, failed


# tokens and their features


class Token(NamedTuple):
    number: int  # among the document's tokens
    start: int
    text: str  # without signs around it
    before: str  # the word before it and the signs between


def tokens(text: str) -> list[Token]:
    """The tokens with a digit or an at sign."""
    found, end, word = [], 0, ""
    for number, m in enumerate(_TOKEN.finditer(text)):
        s = m.group()
        if _DIGIT.search(s):
            core = s.lstrip(_AROUND)
            start = m.start() + len(s) - len(core)
            core = core.rstrip(_AROUND)
            if core:
                between = "".join(text[end : min(start, end + 8)].split())[:3]
                found.append(Token(number, start, core, sys.intern((word if len(word) <= 12 else "") + between)))
            word = "9"
        else:
            word = s.lower()
        end = m.end()
    return found


def _shape(s: str) -> str:
    """Runs of letters and digits; of a shape with many runs, how long it is and what it is made of."""
    shape = _DIGITS.sub(lambda m: f"9{min(len(m.group()), 20)}", _LETTERS.sub("a", s))
    if len(shape) < 16:
        return shape
    return f"odd{len(s).bit_length()}{'w' if s.isalnum() else 's'}"


def _form(s: str) -> str:
    if "@" in s:
        return "email" if emails(s) == [(0, len(s))] else "at"
    if _IP.fullmatch(s):
        return "ip" if well_formed(1, s) else "noip"
    if s.isascii() and s.isdigit():
        return f"{'luhn' if luhn(s) else 'sum'}{13 <= len(s) <= 19}"
    return "key" if well_formed(4, s) else "none"


def _key(t: Token) -> str:
    """Equal for data that repeats or is alike; empty if too short to say."""
    if "@" in t.text:
        return t.text.lower()
    if t.text.count(".") == 3 and _IP.fullmatch(t.text) and well_formed(1, t.text):
        return t.text
    if _SECRET.fullmatch(t.text) and not t.text.isdigit():
        return t.text.lower()
    digits = _only_digits(t.text)
    return digits[-7:] if len(digits) >= 6 else ""


FEATURES = 7


def features(row: list[Token]) -> list[list[str]]:
    """FEATURES names a token."""
    shapes = [sys.intern(_shape(t.text)) for t in row]
    out = []
    for i, t in enumerate(row):
        left = i and row[i - 1].number == t.number - 1
        right = i + 1 < len(row) and row[i + 1].number == t.number + 1
        names = ("", f"s{shapes[i]}", f"f{_form(t.text)}", f"l{shapes[i - 1] if left else ''}", f"r{shapes[i + 1] if right else ''}", f"p{t.text[:1] if t.text[:1] in '+(' else ''}", f"b{t.before}")
        out.append([sys.intern(x) for x in names])
    return out


def edges(row: list[Token]) -> tuple[np.ndarray, np.ndarray]:
    """Chain edges between neighbours, and skip edges from each token to the next with its key."""
    chain = [i for i in range(1, len(row)) if row[i - 1].number == row[i].number - 1]
    first, second, seen = [], [], {}
    for i, t in enumerate(row):
        key = _key(t)
        if key:
            if key in seen:
                first.append(seen[key])
                second.append(i)
            seen[key] = i
    at = np.array(chain, np.int64)
    return np.stack([at - 1, at], axis=1), np.array([first, second], np.int64).T.reshape(-1, 2)


def silver(row: list[Token], spans: list[Span], failed: list[tuple[int, int]]) -> list[int]:
    """Labels of tokens by the spans that they lie in, secrets by assignment; -1 in matches that failed their check."""
    labels = [0] * len(row)
    at = [t.start for t in row]

    def inside(a: int, b: int) -> range:
        first = bisect.bisect_left(at, a)
        if first and at[first - 1] + len(row[first - 1].text) > a:
            first -= 1
        return range(first, bisect.bisect_left(at, b))

    for a, b in failed:
        for i in inside(a, b):
            labels[i] = -1
    for kind, a, b in spans:
        first = True
        for i in inside(a, b):
            if labels[i] <= 0:
                labels[i] = 1 + 2 * kind + (not first)
                first = False
    for i, t in enumerate(row):
        if labels[i] == 0 and t.before[-3:].strip("\"'")[-1:] in ("=", ":") and well_formed(4, t.text):
            labels[i] = 1 + 2 * 4
    return labels


# the field


@dataclass
class Field:
    """Weights of features, of neighbouring labels and of tied labels."""

    index: dict[str, int]
    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def potentials(self, rows: list[list[str]]) -> np.ndarray:
        known = np.concatenate([self.unary, np.zeros((1, LABELS))]).astype(np.float32)  # the last row is of unknown features
        out = np.zeros((len(rows), LABELS), np.float32)
        for a in range(0, len(rows), ROWS):
            at = np.array([[self.index.get(f, -1) for f in row] for row in rows[a : a + ROWS]], np.int64)
            for j in range(at.shape[1]):
                out[a : a + ROWS] += known[at[:, j]]
        return out

    def marginals(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray, rounds: int = 30, owner: np.ndarray | None = None) -> np.ndarray:
        """Loopy sum-product: all messages along all edges, both ways, until those of the node's owner settle.

        A node has one chain edge and one skip edge on either side at most, so no two messages of a group of edges meet.
        """
        owner = np.zeros(len(unary), np.int64) if owner is None else owner
        groups = [(e, np.exp(w).astype(np.float32)) for e, w in ((chain, self.chain), (skip, self.skip)) if len(e)]
        sent = [np.zeros((2, len(e), LABELS), np.float32) for e, _ in groups]  # to the second and to the first end
        live = [np.arange(len(e)) for e, _ in groups]

        def belief() -> np.ndarray:
            out = unary.astype(np.float32)
            for (e, _), m in zip(groups, sent):
                out[e[:, 1]] += m[0]
                out[e[:, 0]] += m[1]
            return out

        for _ in range(rounds):
            now = belief()
            moved = np.zeros(int(owner.max(initial=0)) + 1, np.float32)
            for (e, w), m, on in zip(groups, sent, live):
                for k in range(0, len(on), ROWS):
                    part = on[k : k + ROWS]
                    a, b = e[part].T
                    for j, new in ((0, _through(now[a] - m[1, part], w)), (1, _through(now[b] - m[0, part], w.T))):
                        first = np.flatnonzero(np.diff(owner[a], prepend=-1))  # edges are in the order of owners
                        moved[owner[a][first]] = np.maximum(moved[owner[a][first]], np.maximum.reduceat(np.abs(new - m[j, part]).max(1), first))
                        # both directions read `now`, and each its own last message, so the order doesn't matter
                        if j == 0:
                            second = new
                        else:
                            m[0, part] = 0.5 * m[0, part] + 0.5 * second
                            m[1, part] = 0.5 * m[1, part] + 0.5 * new
            live = [on[moved[owner[e[on, 0]]] >= 1e-4] for (e, _), on in zip(groups, live)]
            if not any(map(len, live)):
                break
        return _softmax(belief())


def _through(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Log of exp(x) times w, less its largest entry."""
    out = np.log(np.exp(x - x.max(1, keepdims=True)) @ w)
    return out - out.max(1, keepdims=True)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


Example = tuple[list[list[str]], list[int], list, list]  # features, labels, chain edges, skip edges
HIDDEN = ["", *["?"] * (FEATURES - 1)]
WRITINGS = ((4, "."), (3, "."), (4, "/"), (3, "/"), (5, "_"), (3, "-"))


def mentioned_again(example: Example, row: list[Token], text: str, spans: list[Span]) -> Example:
    """The example with its data standing once more, where only a tie can tell.

    A card or phone number is mentioned in another writing, tied to its token, beside another number in the same
    writing, itself tied to a copy, which is nobody's; any other keyed token is mentioned without features.
    """
    feats, labels, chain, skip = list(example[0]), list(example[1]), example[2], []

    def add(names: list[str], y: int) -> int:
        feats.append(names)
        labels.append(y)
        return len(feats) - 1

    keys = [_key(t) for t in row]
    done = set()
    for kind, a, b in spans:
        digits = _only_digits(text[a:b])
        ties = [i for i, t in enumerate(row) if a <= t.start < b and keys[i] == digits[-7:]] if kind in (2, 3) else []
        if not ties:
            continue
        done.update(ties)
        size, sign = WRITINGS[int(digits[-2:]) % len(WRITINGS)]
        for number, y in ((digits, 1 + 2 * kind), (digits[::-1], 0)):
            names = features([Token(0, 0, sign.join(number[j : j + size] for j in range(0, len(number), size)), "")])[0]
            at = add(names, y)
            skip.append((ties[-1] if y else add(names, 0), at))
    for i, key in enumerate(keys):
        if key and labels[i] >= 0 and i not in done:
            skip.append((i, add(HIDDEN, labels[i])))
    return feats, labels, chain, skip


def fit_field(examples: list[Example], steps: int = 400, penalty: float = 1e-4) -> Field | None:
    """Pseudo-likelihood with the neighbours' labels given, by Adam over all labelled nodes; None without any span."""
    index: dict[str, int] = {}
    rows, labels, chain, skip = [], [], [], []
    for feats, y, c, s in examples:
        at = len(rows)
        rows += [[index.setdefault(f, len(index)) for f in row] for row in feats]
        labels += y
        chain += [(a + at, b + at) for a, b in c]
        skip += [(a + at, b + at) for a, b in s]
    if not any(y > 0 for y in labels):
        return None
    x, given = np.array(rows), np.array(labels)
    y = np.maximum(given, 0)
    chain, skip = np.array(chain, np.int64).reshape(-1, 2), np.array(skip, np.int64).reshape(-1, 2)
    n = len(y)
    # the labels on either side over each kind of edge; where there is none or none is known, nothing (the last row)
    sides = np.full((4, n), LABELS)
    for k, e in ((0, chain), (2, skip)):
        sides[k, e[:, 1]] = np.where(given[e[:, 0]] < 0, LABELS, y[e[:, 0]])
        sides[k + 1, e[:, 0]] = np.where(given[e[:, 1]] < 0, LABELS, y[e[:, 1]])
    near = np.isin(np.arange(n), chain[:, 1]), np.isin(np.arange(n), chain[:, 0])
    sides[0, ~near[0]] = sides[1, ~near[1]] = 0  # a clamped neighbour is outside
    theta = [np.zeros((len(index), LABELS)), np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS))]
    first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    one = np.concatenate([np.eye(LABELS), np.zeros((1, LABELS))])
    weight = (given >= 0)[:, None] / max(1, (given >= 0).sum())
    for step in range(1, steps + 1):
        unary, t, s = theta
        scores = unary[x].sum(1) + one[sides[0]] @ t + one[sides[1]] @ t.T + one[sides[2]] @ s + one[sides[3]] @ s.T
        off = (one[y] - _softmax(scores)) * weight
        grads = [np.zeros_like(unary), one[sides[0]].T @ off + (one[sides[1]].T @ off).T, one[sides[2]].T @ off + (one[sides[3]].T @ off).T]
        for j in range(x.shape[1]):
            for c in range(LABELS):
                grads[0][:, c] += np.bincount(x[:, j], off[:, c], len(index))
        for i, g in enumerate(grads):
            g -= penalty * theta[i] / max(n, 1) ** 0.5
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            theta[i] += 0.1 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    theta[2] = (theta[2] + theta[2].T) / 2  # a tie has no direction
    return Field(index, *theta)


def _decode(text: str, row: list[Token], marginal: np.ndarray, skip: np.ndarray, base: list[Span]) -> list[Span]:
    """Spans that the field adds to the base ones."""
    label, sure = marginal.argmax(1), marginal.max(1)
    runs: list[tuple[int, list[int]]] = []
    for i in np.flatnonzero((label > 0) & (sure >= SURE)).tolist():
        kind, begins = (int(label[i]) - 1) // 2, label[i] % 2 == 1
        if not begins and runs and runs[-1][0] == kind and runs[-1][1][-1] == i - 1 and row[i - 1].number == row[i].number - 1:
            runs[-1][1].append(i)
        else:
            runs.append((kind, [i]))
    if not runs:
        return []
    taken = sorted((a, b) for _, a, b in base)
    starts, ends = [a for a, _ in taken], np.maximum.accumulate([b for _, b in taken] or [0])

    def overlaps(a: int, b: int) -> bool:
        before = bisect.bisect_left(starts, b)
        return before > 0 and int(ends[before - 1]) > a

    at = [t.start for t in row]
    confirmed: dict[int, int] = {}  # the kind of data that a token surely is of
    for k, a, b in base:
        for i in range(max(0, bisect.bisect_left(at, a) - 1), bisect.bisect_left(at, b)):
            if at[i] + len(row[i].text) > a:
                confirmed[i] = k
    spans, waiting = [], []
    for kind, members in runs:
        a, b = row[members[0]].start, row[members[-1]].start + len(row[members[-1]].text)
        while b > a and not (text[b - 1].isalnum() or (kind == 4 and text[b - 1] == "=")):
            b -= 1
        if b <= a or overlaps(a, b):
            continue
        s = text[a:b]
        fits = {0: lambda: emails(s) == [(0, len(s))], 1: lambda: bool(_IP.fullmatch(s)), 2: lambda: bool(_CARD.fullmatch(s)), 3: lambda: bool(_PHONE.fullmatch(s)), 4: lambda: True}[kind]()
        if fits and well_formed(kind, s):
            spans.append((kind, a, b))
            confirmed.update(dict.fromkeys(members, kind))
        elif max(sure[members]) >= REPEATS_SURE:
            waiting.append((kind, members, a, b))
    if waiting:
        tied = {}  # tokens of one key form a path
        for i, j in skip.tolist():
            tied.setdefault(i, []).append(j)
            tied.setdefault(j, []).append(i)
        for _ in range(2):  # along all paths forwards, then backwards
            left = []
            for kind, members, a, b in waiting:
                if any(confirmed.get(j) == kind for i in members if sure[i] >= REPEATS_SURE for j in tied.get(i, ())):
                    spans.append((kind, a, b))
                    confirmed.update(dict.fromkeys(members, kind))
                else:
                    left.append((kind, members, a, b))
            waiting = left[::-1]
    return spans


def find(texts: list[str], field: Field | None) -> list[tuple[list[Span], list[Span]]]:
    """Per text its base spans and all spans, each by kind, then start. One message passing over all texts' graphs."""
    base = [base_spans(t)[0] if _DIGIT.search(t) else [] for t in texts]
    every = [list(b) for b in base]
    if field is None:
        return [(sorted(b), sorted(e)) for b, e in zip(base, every)]
    held: list[tuple[int, list[Token], np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def flush():
        nonlocal held, size
        if not held:
            return
        at = np.cumsum([0, *(len(h[1]) for h in held)])
        chain = np.concatenate([h[2] + a for h, a in zip(held, at)])
        skip = np.concatenate([h[3] + a for h, a in zip(held, at)])
        unary = np.concatenate([h[4] for h in held])
        alone = np.ones((2, len(unary)), bool)
        alone[0, chain[:, 1]] = alone[1, chain[:, 0]] = False
        unary[alone[0]] += field.chain[0].astype(np.float32)
        unary[alone[1]] += field.chain[:, 0].astype(np.float32)
        marginal = field.marginals(unary, chain, skip, owner=np.repeat(np.arange(len(held)), np.diff(at)))
        for (i, row, _, s, _), a, b in zip(held, at, at[1:]):
            every[i] += _decode(texts[i], row, marginal[a:b], s, base[i])
        held, size = [], 0

    for i, t in enumerate(texts):
        row = tokens(t) if _DIGIT.search(t) else []
        if row:
            held.append((i, row, *edges(row), field.potentials(features(row))))
            size += len(row)
            if size >= ROWS:
                flush()
    flush()
    return [(sorted(b), sorted(e)) for b, e in zip(base, every)]


def _text_of(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def examples_of(text: str) -> list[Example]:
    row = tokens(text)
    if not row:
        return []
    spans, failed = base_spans(text)
    labels = silver(row, spans, failed)
    row, labels = row[:MOST_NODES], labels[:MOST_NODES]
    chain, skip = edges(row)
    example = features(row), labels, chain.tolist(), skip.tolist()
    return [example, mentioned_again(example, row, text, spans)]


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [json.dumps(x) for t in batch.column("text").to_pylist() for x in examples_of(t)]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["example"])


def fit(docs: DataFrame, fit_documents: int = FIT_DOCUMENTS) -> Field | None:
    """Learns from a sample of the texts with digits or at signs; equal rows are drawn as one."""
    held = whole_texts(docs).where(F.col("text").rlike("[0-9@]"))
    n = held.count()
    drawn = held.select("text", F.xxhash64(F.lit("pii"), "doc_id", "text").alias("draw")).where(F.shiftrightunsigned("draw", 11) < F.lit(int(min(1.0, fit_documents / max(n, 1)) * (1 << 53))))
    rows = drawn.dropDuplicates(["draw"]).limit(2 * fit_documents).select("text").mapInArrow(_examples, "example string").collect()
    return fit_field([json.loads(x) for x in sorted(r.example for r in rows)])


def personal_data(docs: DataFrame, field: Field | None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_spans): counts and digest of the base
    spans; all spans; the secrets among them and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 100):
                batch = whole.slice(start, 100)
                found = find(batch.column("text").to_pylist(), field)
                counts = [pa.array([sum(s[0] == k for s in b) for b, _ in found], pa.int64()) for k in range(BASE)]
                digests = [hashlib.sha256(_text_of(b).encode()).hexdigest() for b, _ in found]
                more = [pa.array([sum(s[0] == BASE for s in e) for _, e in found], pa.int64()), pa.array([len(e) for _, e in found], pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array(digests, pa.string()), pa.array([_text_of(e) for _, e in found], pa.string()), *more], ["doc_id", *(f"n_{k}" for k in KINDS[:BASE]), "base_sha256", "spans", "n_secret", "n_spans"])

    return whole_texts(docs).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_secret long, n_spans long")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return personal_data(docs, fit(docs))
