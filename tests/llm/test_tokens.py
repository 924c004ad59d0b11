"""Byte-level BPE and token counts against the public tokenizer itself."""

from __future__ import annotations

import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import bpe, counts

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary")
SAMPLES = ["", "a", "it's we'll I'VE 'tis 'r", "  two  spaces \n\n\t x", "½² ⅷ 日本語 naïve ﬁ", "👩‍👩‍👧 ok", "x" * 5000, "ab" * 3000, "<|endoftext|> plain", "a b\x1cc", "1234567 3.14 ''''s", "\x00\x01"]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.VOCABULARY)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def encoded(texts):
    ids, offsets = bpe.encode_texts(bpe.load_vocabulary(), texts)
    return [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])]


def test_samples(reference):
    assert encoded(SAMPLES) == reference(SAMPLES)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), min_size=1, max_size=5))
def test_any_text(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.VOCABULARY)
    t.encode_special_tokens = True
    v = bpe.load_vocabulary()
    ids, offsets = bpe.encode_texts(v, texts)
    data, ends = v.decode_bytes(ids, offsets)
    assert [data[a:b].tobytes().decode() for a, b in zip(ends[:-1], ends[1:])] == texts
    n, pre = counts.count_texts(merger(), texts)
    assert n.tolist() == np.diff(offsets).tolist()
    assert pre.tolist() == [len(bpe.PATTERN.findall(x)) for x in texts]


_KEPT: list[counts.Merger] = []


def merger() -> counts.Merger:
    if not _KEPT:
        _KEPT.append(counts.Merger(bpe.load_vocabulary()))
    return _KEPT[0]


ODD = ["abc\u1c8adef 12\u1c8a", "\u088f\u0c5c \u208f\u0558 \U000323b0x", "a\x1cb\x85c\u180ed"]
LONG = ["x" * 20_000, "ab" * 9_000 + " tail", "abcdefgh"[::-1] * 300 + "".join("aeiou"[i * i % 5] for i in range(9_000)), "\u65e5\u672c\u8a9e" * 3_000, "=-" * 4_000 + " it's"]


@pytest.mark.parametrize("lane,states", [(1024, 250_000), (64, 250_000), (64, 40)])
def test_long_pre_tokens_and_forgotten_states(lane, states, monkeypatch):
    """Parts of long pre-tokens compose to the counts of the whole, also when states are forgotten in between."""
    monkeypatch.setattr(counts, "LANE", lane)
    monkeypatch.setattr(counts, "MAX_STATES", states)
    v, texts = bpe.load_vocabulary(), [*SAMPLES, *ODD, *LONG, ""]
    own = counts.Merger(v)
    n, pre = counts.count_texts(own, texts)
    assert n.tolist() == np.diff(bpe.encode_texts(v, texts)[1]).tolist()
    assert pre.tolist() == [len(bpe.PATTERN.findall(x)) for x in texts]
    assert states > 40 or len(own.states) < 400


def test_classes_are_those_of_the_splitting_engine():
    import regex

    classes = counts.character_classes()
    for c in (*range(0x3000), 0x1C8A, 0x323B0):
        if not 0xD800 <= c < 0xE000:
            assert (classes[c] in (counts.LETTER, counts.STMD, counts.RV, counts.E, counts.L)) == bool(regex.match(r"\p{L}", chr(c)))
            assert (classes[c] == counts.NUMBER) == bool(regex.match(r"\p{N}", chr(c)))


def test_both_vocabulary_files_agree():
    a = bpe.load_vocabulary()
    b = bpe.load_vocabulary(bpe.VOCABULARY.replace(".json", ".tiktoken"))
    for text in SAMPLES:
        assert [a.by_id[i] for i in bpe.encode_texts(a, [text])[0]] == [b.by_id[i] for i in bpe.encode_texts(b, [text])[0]]


def test_queue_gives_ranks_in_order():
    q = bpe.RankQueue(50_000)
    rng = np.random.default_rng(0)
    left = set()
    for _ in range(20):
        r = rng.integers(-5, 50_000, 50)
        q.push(r, np.arange(50))
        left |= set(r[r >= 0].tolist())
        for _ in range(10):
            assert q.first() == min(left)
            q.take(q.first())
            left.remove(min(left))


def test_quick_pattern_is_the_same_where_it_is_used():
    for code in range(0x3000):
        text = f"a{chr(code)}{chr(code)} 1{chr(code)}" if not 0xD800 <= code < 0xE000 else ""
        assert bpe.pre_tokens(text) == bpe.PATTERN.findall(text), hex(code)


def test_awkward_tables(awkward, empty):
    rows = bpe.encode(awkward).collect()
    assert len(rows) == awkward.count() and sum(r.token_ids is None for r in rows) == 2
    for r in rows:
        if r.token_ids is None:
            assert r.n_tokens is None and r.round_trip is None
        else:
            assert r.n_tokens == len(r.token_ids) and r.round_trip
    assert sorted(str((r.doc_id, r.n_tokens)) for r in rows) == sorted(str((r.doc_id, r.n_tokens)) for r in counts.count(awkward).collect())
    assert bpe.encode(empty).count() == counts.count(empty).count() == 0
    back = bpe.decode(bpe.encode(awkward)).collect()
    assert sorted(str((r.doc_id, r.text)) for r in back) == sorted(str((r[0], r[1])) for r in awkward.collect())


def test_decode_skips_what_is_no_id(spark):
    df = spark.createDataFrame([(1, [64, None, -1, 10**6, 65]), (2, None), (3, [])], "doc_id long, token_ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode(df).collect()} == {1: "ab", 2: None, 3: ""}


def test_whole_table(tables, reference):
    docs = {r.doc_id: r.text for r in tables["documents"].collect()}
    got = {r.doc_id: r.token_ids for r in bpe.encode(tables["documents"]).collect()}
    assert got == dict(zip(docs, reference(list(docs.values()))))
    assert {r.doc_id: r.n_tokens for r in counts.count(tables["documents"]).collect()} == {k: len(v) for k, v in got.items()}
