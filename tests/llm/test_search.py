"""Near duplicates, fingerprints and decontamination against brute force."""

from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import _frames, decontam, ngram_join, simhash
from tests.llm.conftest import prose


def grams(text: str, n: int = 3) -> frozenset:
    w = text.split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def changed(text: str, share: float, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(f"new{r.randrange(10**6)}" if r.random() < share else w for w in text.split())


@pytest.fixture(scope="module")
def copies(spark):
    """Groups of exact and near copies, from 2 to 40 documents, among texts of their own."""
    rows, k = [], 0
    for g in range(12):
        base = prose(120, 100 + g)
        for c in range((2, 3, 5, 40)[g % 4]):
            rows.append((k, base if c % 3 == 0 else changed(base, 0.01 * (c % 7), 31 * g + c)))
            k += 1
    for s in range(60):
        rows.append((k, prose(100, 900 + s)))
        k += 1
    return rows


def brute_classes(rows, threshold):
    """By (id, set): (class, links, greatest similarity); and the least (id, set) of each class."""
    sets = {}
    for d, t in rows:
        if t and grams(t):
            sets[d, grams(t)] = None
    own = list(sets)
    order = lambda x: (x[0] is None, x[0] or 0)
    leader = {x: x for x in own}
    links, best = Counter(), Counter()
    edges = []
    for a, b in combinations(own, 2):
        both = len(a[1] & b[1])
        j = both / (len(a[1]) + len(b[1]) - both)
        if j >= threshold:
            edges.append((a, b))
            for x in (a, b):
                links[x] += 1
                best[x] = max(best[x], j)
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            low = min(leader[a], leader[b], key=order)
            moved |= order(leader[a]) != order(low) or order(leader[b]) != order(low)
            leader[a] = leader[b] = low
    return {x: (leader[x][0], links[x], round(best[x], 6)) for x in own if links[x]}, leader


@pytest.mark.parametrize("threshold", [0.5, 0.7])
def test_join_against_all_pairs(spark, copies, threshold):
    want = {(d, *v) for (d, _), v in brute_classes(copies, threshold)[0].items()}
    got = {tuple(r) for r in ngram_join.join(spark.createDataFrame(copies, "doc_id long, text string"), threshold=threshold).collect()}
    assert {x[0] for x in got} <= {x[0] for x in want} and len(got & want) >= 0.97 * len(want)
    assert sum(x[2] for x in got) >= 0.97 * sum(x[2] for x in want)


def test_join_does_not_depend_on_blocks_or_hot_keys(spark, copies, monkeypatch):
    df = spark.createDataFrame(copies, "doc_id long, text string")
    want = set(ngram_join.join(df).collect())
    kept = {d for d, _ in copies} - {r.doc_id for r in want if r.doc_id != r.class_id}
    for module, name, value in ((ngram_join, "BLOCK", 7), (_frames, "HOT_ROWS", 3), (_frames, "HOT_SHARE", 1_000_000), (_frames, "BROADCAST_KEYS", 0), (ngram_join, "BROADCAST_KEYS", 0), (ngram_join, "FEW_EDGES", 0)):
        monkeypatch.setattr(module, name, value)
    assert set(ngram_join.join(df).collect()) == want
    assert {r.doc_id for r in ngram_join.drop_duplicates(df).collect()} == kept


def test_repeated_ids_in_any_order(spark):
    """Different texts of one id are documents of their own; rows that repeat aren't; nothing depends on the order."""
    a, b = prose(120, 1), prose(120, 2)
    near = changed(a, 0.02, 5)
    rows = [(1, near), (2, a), (2, b), (2, a), (2, a.replace(" ", "\n")), (None, a), (None, prose(50, 3)), (None, prose(50, 3)), (3, None), (4, " ")]
    want, leader = brute_classes(rows, 0.5)
    for own in (rows, rows[::-1]):
        df = spark.createDataFrame(own, "doc_id long, text string").repartition(3)
        assert sorted(map(repr, ((r.doc_id, r.class_id, r.links, r.jaccard) for r in ngram_join.join(df).collect()))) == sorted(map(repr, ((d, *v) for (d, _), v in want.items())))
        kept = [(r.doc_id, r.text) for r in ngram_join.drop_duplicates(df).collect()]
        assert sorted(map(repr, kept)) == sorted(map(repr, [(1, near), (2, b), (None, prose(50, 3)), (3, None), (4, " ")]))
    assert {x for x, y in leader.items() if x == y} == {(1, grams(near)), (2, grams(b)), (None, grams(prose(50, 3)))}


@pytest.mark.parametrize("few", [0, 10**6])
def test_groups(spark, few, monkeypatch):
    monkeypatch.setattr(ngram_join, "FEW_EDGES", few)
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 50)] + [tuple(sorted(rng.sample(range(100, 160), 2))) for _ in range(40)]
    odd = [(7, 7), (None, 3), (3, None), (500, 500), (51, 50)]
    got = {r.doc_id: r.leader for r in ngram_join.groups(spark.createDataFrame(edges + odd, "doc_a long, doc_b long")).collect()}
    leader = {x: x for e in [*edges, (50, 51)] for x in e}
    for _ in range(200):
        for a, b in [*edges, (50, 51)]:
            leader[a] = leader[b] = min(leader[a], leader[b])
    assert got == leader
    assert ngram_join.groups(spark.createDataFrame([], "doc_a long, doc_b long")).count() == 0


def test_fewest_matches_is_the_posterior():
    # by the sum of the Beta density, on a fine grid
    x = (np.arange(200_000) + 0.5) / 200_000
    for n, m in zip(range(16, 129, 16), ngram_join.fewest_matches(0.5, 0.001)):
        def tail(k, n=n):
            d = np.exp(k * np.log(x) + (n - k) * np.log1p(-x) + 60)
            return d[x >= 0.5].sum() / d.sum()

        assert tail(m) >= 0.001 > (tail(m - 1) if m else 0)


def test_join_awkward(awkward, empty):
    rows = [(r[0], r[1]) for r in awkward.collect()]
    got = [(r.doc_id, r.class_id, r.links, r.jaccard) for r in ngram_join.join(awkward).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, ((d, *v) for (d, _), v in brute_classes(rows, 0.5)[0].items())))
    assert {g[0] for g in got} == {1, 8, 9}
    assert ngram_join.join(empty).count() == 0
    kept = ngram_join.drop_duplicates(awkward)
    assert kept.columns == awkward.columns
    ids = [r[0] for r in kept.collect()]
    assert ids.count(1) == 1 and 8 not in ids and ids.count(9) == 1 and ids.count(None) == 2 and {2, 3, 4, 5, 6, 7, 10} <= set(ids)
    assert ngram_join.drop_duplicates(empty).count() == 0


def slow_simhash(text: str) -> int | None:
    import hashlib

    h = [int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "big") for w in text.lower().split()]
    if not h:
        return None
    terms = h if len(h) == 1 else [(a * 31 + b) % 2**64 for a, b in zip(h, h[1:])]
    return sum(1 << i for i in range(64) if sum(1 if t >> i & 1 else -1 for t in terms) > 0)


def test_simhash_values():
    texts = [prose(n, n) for n in (1, 2, 3, 10, 300)] + ["", "A a A", prose(2000, 9) * 40]
    value, some = simhash.simhash(pa.array(texts))
    assert [int(v) if s else None for v, s in zip(value, some)] == [slow_simhash(t) for t in texts]


@pytest.mark.parametrize("radius,blocks", [(3, 6), (3, 4), (5, 8), (0, 1)])
def test_near_fingerprints(spark, radius, blocks):
    rng = random.Random(radius)
    rows = []
    for i in range(400):
        base = rng.getrandbits(64)
        rows.append((i, base))
        for _ in range(rng.randrange(3)):
            x = base
            for b in rng.sample(range(64), rng.randrange(0, 7)):
                x ^= 1 << b
            rows.append((1000 + len(rows), x))
    signed = [(d, f - (1 << 64) if f >> 63 else f) for d, f in rows]
    got = {(r.doc_a, r.doc_b): r.distance for r in simhash.near(spark.createDataFrame(signed, "doc_id long, fingerprint long"), radius, blocks).collect()}
    least = {}
    for d, f in sorted(rows):
        least.setdefault(f, d)
    want = {(least[f], d): 0 for d, f in rows if least[f] != d}
    for (f, a), (g, b) in combinations(least.items(), 2):
        if (f ^ g).bit_count() <= radius:
            want[min(a, b), max(a, b)] = (f ^ g).bit_count()
    assert got == want


def test_fingerprints_awkward(awkward, empty):
    own = simhash.fingerprints(awkward)
    assert own.count() == 10
    assert {(1, 8, 0), (1, 9, 0)} <= {tuple(r) for r in simhash.near(own).collect()}
    assert simhash.near(simhash.fingerprints(empty)).count() == 0


# decontamination


@pytest.fixture(scope="module")
def items():
    return [(i, prose(20 + 3 * i, 5000 + i) + f". answer{i} is final{i}.") for i in range(30)]


def slow_scores(index: decontam.Index, terms: set[str]) -> dict[int, float]:
    out = Counter()
    for w in terms:
        if w in index.number:
            for s, x in zip(index.docs[index.number[w]], index.impacts[index.number[w]]):
                out[s] += x
    return out


@pytest.mark.parametrize("threshold", [0.2, 0.4, 0.8])
def test_retrieval_is_exhaustive(items, threshold):
    index = decontam.Index([decontam.Item(i, *decontam.question_and_answer(t)) for i, t in items])
    rng = random.Random(1)
    texts = []
    for k in range(60):
        w = prose(200, 7000 + k).split()
        own = items[k % 30][1].split()
        a = rng.randrange(150)
        w[a:a] = own[: rng.randrange(len(own) + 1)]
        texts.append(" ".join(w))
    offsets, words = decontam.split_words(pa.array(texts))
    coded = words.dictionary_encode()
    offsets, code = decontam._codes(offsets, coded, decontam.normalise(coded.dictionary), index)
    got = {(d, a, b): dict(hits) for d, a, b, hits in decontam.retrieve(offsets, code, index, threshold)}
    maxima, seen = index.maxima(), 0
    for d in range(len(texts)):
        n = int(offsets[d + 1] - offsets[d])
        for k in range(1 if n <= decontam.PASSAGE else -(-(n - decontam.PASSAGE) // decontam.STRIDE) + 1):
            a = int(offsets[d]) + k * decontam.STRIDE
            b = min(a + decontam.PASSAGE, int(offsets[d + 1]))
            terms = [int(t) for t in np.unique(code[a:b]) if t < len(index.terms)]
            want = {s: x for s, x in slow_scores(index, {index.terms[t] for t in terms}).items() if x >= threshold - 1e-9}
            assert {s: round(x, 9) for s, x in got.get((d, a, b), {}).items()} == {s: round(x, 9) for s, x in want.items()}
            assert {s for s, _ in index.search(terms, threshold, maxima)} == set(want)
            seen += len(want)
    assert seen > 20


def test_planted_items_are_found_and_clean_texts_left(spark, items):
    rows, leaks = [], set()
    for k in range(90):
        w = prose(300, 9000 + k).split()
        if k % 3 == 0:
            own = items[k % 30][1]
            if k % 2:
                own = own.upper().replace(" ", ",  ", 3)
            w[50 + k : 50 + k] = own.split()
            leaks.add((k, items[k % 30][0]))
        rows.append((k, " ".join(w)))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.find(docs, bench).collect()} == leaks
    assert {r.doc_id for r in decontam.drop_contaminated(docs, bench).collect()} == set(range(90)) - {d for d, _ in leaks}


def test_many_indexes_give_the_same(spark, items, monkeypatch):
    docs = spark.createDataFrame([(i, prose(70, i) + " " + t) for i, t in items], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(decontam.find(docs, bench).collect())
    monkeypatch.setattr(decontam, "INDEX_WORDS", 150)
    monkeypatch.setattr(decontam, "INDEXES", 3)
    assert len(decontam.load_indexes(bench)) > 6 and sorted(decontam.find(docs, bench).collect()) == want


def test_decontamination_awkward(spark, awkward, empty):
    bench = spark.createDataFrame([(1, prose(80, 2), "x"), (1, prose(80, 2), "x"), (None, "a b c", "y"), (2, None, None), (3, "", ""), (4, "word", "")], "item_id long, text string, Item_Id string")
    got = {(r.doc_id, r.item_id) for r in decontam.find(awkward, bench).collect()}
    assert got == {(1, 1), (8, 1), (9, 1)}
    kept = decontam.drop_contaminated(awkward, bench)
    assert kept.columns == awkward.columns and kept.count() == awkward.count() - 4
    assert decontam.find(empty, bench).count() == decontam.find(awkward, bench.limit(0)).count() == 0
    assert decontam.drop_contaminated(awkward, bench.limit(0)).count() == awkward.count()
