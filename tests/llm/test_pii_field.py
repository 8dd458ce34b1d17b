"""The skip-chain field: what its ties find, secrets, independence of documents, memory of a long text."""

from __future__ import annotations

import copy
import resource

import numpy as np
import pytest

from tempora.llm import pii
from tempora.llm.common import load


@pytest.fixture(scope="module")
def field(spark):
    return pii.fit(load(spark, "/root/testdata/sf0.1", "documents"))


def found(text, field):
    return [(pii.KINDS[k], text[a:b]) for k, a, b in pii.find([text], field)[0][1]]


CARD = "Card 4524132264652876 first. Later 4524.1322.6465.2876 again."
PHONE = "Call +1 (269) 555-3296 now.\nThen (269) 555-3296 again."


def test_ties_find_other_writings(field):
    """Without the weights of skip edges the second mentions are not found; without a first mention neither."""
    assert ("card", "4524.1322.6465.2876") in found(CARD, field)
    assert any(k == "phone" and "555-3296" in s and "+1" not in s for k, s in found(PHONE, field))
    untied = copy.copy(field)
    untied.skip = np.zeros_like(field.skip)
    assert ("card", "4524.1322.6465.2876") not in found(CARD, untied)
    assert not found("Later 4524.1322.6465.2876 again, 555-3296.", field)
    assert np.diag(field.skip)[[0, 1, 3, 5]].min() > 1  # learned, not set


def test_secrets(field):
    secret = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"
    text = f'so token = "{secret}" and later {secret} once more; version 2.0 of 1999, ' + "a" * 40
    assert found(text, field) == [("secret", secret)] * 2
    assert pii.base_spans(text)[0] == []


def test_documents_settle_alone(field):
    texts = [CARD, PHONE, "nothing 12 here", CARD + PHONE, "", "1.2.3.4 " * 50]
    assert pii.find(texts, field) == [pii.find([t], field)[0] for t in texts]


def test_long_text_in_bounded_memory(field):
    text = "12345678 " * 100_000 + CARD
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    spans = pii.find([text], field)[0][1]
    assert [text[a:b] for _, a, b in spans] == ["4524132264652876", "4524.1322.6465.2876"]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500 << 10


def test_tokens_of_failing_matches_have_no_label():
    text = "x 300.1.2.3 and 1.2.3.4"
    row = pii.tokens(text)
    assert pii.silver(row, *pii.base_spans(text)) == [-1, 3]


def test_sample_is_bounded(spark, field):
    docs = spark.createDataFrame([(7, "call 4524132264652876")] * 500 + [(i, f"{i} at 1.2.3.{i % 250}") for i in range(300)], "doc_id long, text string")
    assert pii.fit(docs, 50) is not None
    assert len(pii.examples_of("1 " * 100_000)[0][0]) == pii.MOST_NODES
