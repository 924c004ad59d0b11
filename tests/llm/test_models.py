"""Personal data, quality and toxicity: held-out accuracy, gradients, consistency, awkward tables."""

from __future__ import annotations

import math
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import pii, quality, toxicity


@pytest.fixture(scope="module")
def potentials():
    return pii.train()


def test_entities_of_generated_texts(potentials):
    texts, gold = pii.generate(300, seed=99)
    right = found = there = 0
    for own, want in zip(pii.entities(texts, potentials), gold):
        right += len(set(own) & set(want))
        found += len(own)
        there += len(want)
    assert right / found > 0.93 and right / there > 0.93


def test_decoys_stay(potentials):
    texts = ["see page 12 of 2019 for $300 and 5%", "order 9870157079875996 shipped on 2020-10-11", "version 1.2.3 at 10:45", "CAPITALLETTERSONLY here", "x = 3 and y=4"]
    assert pii.entities(texts, potentials) == [[]] * len(texts)


def test_plain_cases(potentials):
    texts = {"write to ann.lee@mail.example.com now": "EMAIL", "host 10.20.30.40 fails": "IP", "call +1 (212) 555-0199 today": "PHONE", "paid with 4111111111111111 twice": "CARD", 'token = "0f3a9c0f3a9c0f3a9c0f3a9c0f3a9c0f3a9c0f3a"': "SECRET"}
    for (text, label), own in zip(texts.items(), pii.entities(list(texts), potentials)):
        assert [e[2] for e in own] == [label], text
    assert pii.redact("a 10.20.30.40!! b", pii.entities(["a 10.20.30.40!! b"], potentials)[0]) == "a <IP>!! b"


def test_potentials_are_those_of_training(potentials):
    for name, own in pii.fitted().items():
        assert np.allclose(own, potentials[name], atol=0.02), name


def test_skip_edges_carry_labels(potentials):
    """A value that a name gives away is found again where nothing does: without skip edges fewer are."""
    texts, gold = pii.generate(300, seed=99)
    none = dict(potentials)
    none["skip"] = np.zeros_like(potentials["skip"])
    there = sum(map(len, gold))
    found = lambda p: sum(len(set(own) & set(want)) for own, want in zip(pii.entities(texts, p), gold)) / there
    assert found(potentials) > found(none) + 0.005
    g = pii.Graph(["password=kettle-9 and much later in the text kettle-9 again"])
    assert g.is_skip.sum() == 1 and np.trace(potentials["skip"]) > 0


def slow_labels(text, p, rounds=12):
    """(start, end, label) of the pieces of one text: messages passed edge by edge in plain Python."""
    g, k = pii.Graph([text]), len(pii.LABELS)
    own = [[0.0] * k for _ in range(g.n)]
    for r, c in zip(g.rows.tolist(), g.cols.tolist()):
        own[r] = [x + y for x, y in zip(own[r], p["unary"][c].tolist())]
    psi = [p["skip" if skip else "chain"].tolist() for skip in g.is_skip]
    edges = g.edges.tolist()
    sent = {(e, side): [0.0] * k for e in range(len(edges)) for side in (0, 1)}  # to which end of the edge
    belief = lambda i, but: [own[i][y] + sum(sent[e, side][y] for e, ab in enumerate(edges) for side in (0, 1) if ab[side] == i and (e, side) != but) for y in range(k)]
    for _ in range(rounds):
        new = {}
        for (e, side), old in sent.items():
            b = belief(edges[e][1 - side], (e, 1 - side))
            m = [math.log(sum(math.exp(b[x] + (psi[e][x][y] if side else psi[e][y][x])) for x in range(k))) for y in range(k)]
            new[e, side] = [(o + v - max(m)) / 2 for o, v in zip(old, m)]
        sent = new
    out = []
    for i, (a, b) in enumerate(g.span):
        x = belief(i, None)
        out.append((a, b, x.index(max(x))))
    return out


def test_query_against_plain_message_passing(spark, tables, tmp_path):
    """The query's entities in all documents, generated ones too, are those of plain message passing, put together by hand."""
    from quillon.llm import queries

    p, texts = pii.fitted(), {r.doc_id: r.text for r in tables["documents"].collect()}
    texts |= {10**6 + i: t for i, t in enumerate(pii.generate(60, seed=7)[0])}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in queries.op2_personal_data(spark, str(tmp_path)).collect()}
    assert set(rows) == set(texts)
    checked = 0
    for d, text in texts.items():
        found = [(e.start, e.end, e.label) for e in rows[d].entities]
        assert rows[d].text == pii.redact(text, found)
        n = pii.Graph([text]).n
        if 0 < n <= 60:
            checked += 1
            for a, b, y in slow_labels(text, p):
                hit = [n for s, e, n in found if s < b and a < e]
                assert hit == ([pii.LABELS[y]] if y and text[a:b] != "=" else []), (d, text[a:b])
        assert n or not found
    assert checked > 70


def test_left_words_of_any_length(potentials):
    """A word before another one is found behind words of any length, as by splitting."""
    for n in (3, 39, 40, 41, 5000):
        text = f"password {'x' * n} abc12345 and password: {'y' * n} 77"
        for at in (text.index("abc1"), text.rindex("77")):
            left = pii._Left(text)
            one, place = left(at)
            assert [left(place)[0], one] == text[:at].split()[-2:]


def test_marginals_are_exact_on_trees(potentials):
    g = pii.Graph(["tel: +1 (212) 555-0199 and 10.0.0.1"])
    node, _ = pii.propagate(g, potentials, rounds=60)
    k, own = len(pii.LABELS), np.zeros((g.n, len(pii.LABELS)))
    np.add.at(own, g.rows, potentials["unary"][g.cols])
    total = np.zeros((g.n, k))
    for labels in np.ndindex(*[k] * g.n):
        w = sum(own[i, y] for i, y in enumerate(labels)) + sum(potentials["chain"][labels[a], labels[b]] for a, b in g.edges)
        for i, y in enumerate(labels):
            total[i, y] += math.exp(w)
    assert np.allclose(node, total / total.sum(1, keepdims=True), atol=1e-4)


def test_personal_data_glued_and_long(potentials):
    """Entities glued to other text, and values of any length; what is cut never joins what has a shape."""
    glued = {
        "email=ann.lee@mail.com": "email=<EMAIL>",
        "mailto:ann.lee@mail.com": "mailto:<EMAIL>",
        "ann.lee@mail.com,bob.ray@mail.org": "<EMAIL>,<EMAIL>",
        '{"email":"ann.lee@mail.com","ip":"10.20.30.40","tel":"212-555-0199"}': '{"email":"<EMAIL>","ip":"<IP>","tel":"<PHONE>"}',
        "7,ann.lee@mail.com,10.20.30.40": "7,<EMAIL>,<IP>",
        "请联系ann.lee@mail.com谢谢": "请联系<EMAIL>谢谢",
        "電話212-555-0199。": "電話<PHONE>。",
        "http://10.20.30.40:8080/a": "http://<IP>:8080/a",
        "token=abc123def456,email=a@b.com": "token=<SECRET>,email=<EMAIL>",
    }
    for text, want in glued.items():
        assert pii.redact(text, pii.entities([text], potentials)[0]) == want
    key = "0f3a9c1b" * 1000
    for text, want in ((f"a {key} b", "a <SECRET> b"), (f"a token={key} b", "a token=<SECRET> b"), ("a " + "Qm9i/2+x" * 900 + "== b", "a <SECRET> b")):
        assert pii.redact(text, pii.entities([text], potentials)[0]) == want
    for text in ("a,b1," * 60_000, "a@" * 60_000, "=1" * 60_000, "{(" * 60_000 + "1", "a.1-" * 60_000, "1" * 200_000):
        began = time.time()
        pii.entities([text], potentials)
        assert time.time() - began < 60, text[:9]


def test_personal_data_awkward(awkward, empty):
    rows = pii.find(awkward).collect()
    assert len(rows) == awkward.count() and sum(r.text is None for r in rows) == 2
    masked = pii.mask(awkward)
    assert masked.columns == awkward.columns and masked.count() == awkward.count()
    assert pii.find(empty).count() == pii.mask(empty).count() == 0


def test_masking_updates_lengths(spark):
    df = spark.createDataFrame([(1, "mail a.b@c.example.com x", 24), (2, "nothing", None)], "doc_id long, text string, n_chars long")
    assert [tuple(r) for r in pii.mask(df).orderBy("doc_id").collect()] == [(1, "mail <EMAIL> x", 14), (2, "nothing", None)]


# quality


def samples(n: int, seed: int):
    from tests.llm.conftest import prose

    rng = np.random.default_rng(seed)
    rows, y = [], []
    for i in range(n):
        text = prose(int(rng.integers(30, 200)), seed * 10_000 + i)
        bad = i % 4 == 0
        if bad:
            text = ("!! ".join(text.upper().split()), text.split()[0] * 1 + " " + " ".join([text.split()[0]] * 50), "### ".join(text.split()))[i // 4 % 3]
        rows.append((i, text))
        y.append(int(not bad))
    return rows, y


def test_quality_held_out(spark):
    rows, y = samples(400, 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for (i, _), q in zip(rows, y)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    assert 0 < len(model.rules) < 200
    new, want = samples(200, 2)
    got = {r.doc_id: r for r in quality.score(spark.createDataFrame(new, "doc_id long, text string"), model).collect()}
    assert np.mean([got[i].keep == bool(q) for (i, _), q in zip(new, want)]) > 0.97
    stats = spark.createDataFrame(new, "doc_id long, text string").select("doc_id", quality.statistics(F.col("text")).alias("s")).select("doc_id", "s.*").toPandas()
    assert np.allclose([got[i].quality_score for i in stats.doc_id], model.predict(stats[list(quality.STATISTICS)].to_numpy()), atol=1e-5)
    assert quality.train(docs, labels).rules == model.rules


def test_statistics_by_hand(spark):
    text = "Go go go!\nGo home #1"
    s = spark.createDataFrame([(text,)], "text string").select(quality.statistics(F.col("text")).alias("s")).first().s.asDict()
    n = len(text)
    assert s["words"] == 6 and s["word_length"] == n / 6 and s["upper"] == 2 / n and s["exclaim"] == 1 / n and s["symbols"] == 1 / n
    assert s["letters"] == sum(c.isalpha() for c in text) / n and s["distinct_words"] == 5 / 6 and s["distinct_lines"] == 1 and s["repeats"] == 0


def plain_statistics(text):
    import regex

    t = text or ""
    words, lines = [w for w in re.split("[ \n\t\r\x0b\x0c]", t) if w], [x for x in t.split("\n") if x]
    chars, n, m = max(len(t), 1), max(len(words), 1), max(len(lines), 1)
    share = lambda p: len(regex.findall(p, t)) / chars
    return (len(words), len(t) / n, share(r"\p{Lu}"), share(r"\p{L}"), share("[!?]"), share(r"[#$%&*|<>^~=_{}\[\]\\]"), len(set(words)) / n, len(set(lines)) / m, sum(a == b for a, b in zip(words, words[1:])) / n)


def test_query_against_plain_rules(spark, tables):
    """Every score of the query is the one that rules give, condition by condition, over statistics counted in plain Python."""
    from quillon.llm import queries
    from tests.llm.conftest import DATA

    model = quality.train(tables["documents"], tables["labels"])
    texts = {r.doc_id: r.text for r in tables["documents"].collect()}
    rows = queries.op6_quality(spark, str(DATA)).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts) and model.rules
    for r in rows:
        own = dict(zip(quality.STATISTICS, plain_statistics(texts[r.doc_id])))
        total = model.intercept
        for conditions, weight in model.rules:
            if all(own[name] <= at if low else own[name] > at for name, low, at in conditions):
                total += weight
        assert abs(r.quality_score - (1 / (1 + math.exp(-total)) if own["words"] else 0)) < 2e-6 and r.keep == (r.quality_score >= 0.5)


def test_labels_and_ids_that_repeat(spark):
    """Of an id's labels the worst counts, and a sample of n labels gives n rows however often ids repeat."""
    rows, y = samples(120, 3)
    docs = spark.createDataFrame(rows + rows[::-1] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for (i, _), q in zip(rows, y)] + [(i, 1, 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    once = quality.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, q, 0) for (i, _), q in zip(rows, y)], "doc_id long, quality int, toxic int"))
    assert quality.train(docs, labels) == once and once.rules


def test_quality_awkward(spark, awkward, empty):
    model = quality.RuleModel(1.0, [((("words", True, 3.0),), -0.5)])
    rows = quality.score(awkward, model).collect()
    assert len(rows) == awkward.count()
    assert {r.doc_id for r in rows if r.quality_score == 0} == {2, 3, 4, None}
    kept = quality.keep_good(awkward, model)
    assert kept.columns == awkward.columns and kept.count() == sum(r.keep for r in rows)
    assert quality.score(empty, model).count() == quality.keep_good(empty, model).count() == 0
    no_labels = spark.createDataFrame([(None, 1, 0), (2, None, 1)], "doc_id long, quality int, toxic int")
    assert quality.train(awkward, no_labels).rules == []


# toxicity


def test_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in toxicity._parameters(6, rng).items()}
    tri, offsets = toxicity.trigrams(["alpha", "be", "c", "delta"])
    ids, length, y = np.array([[0, 1, 2, 3, 0], [3, 2, 0, 0, 0]]), np.array([5, 2]), np.array([1.0, 0.0])
    args = (np.array([1, 2, 0, 3]), tri, offsets, ids, length, y)
    _, g = toxicity.loss_and_gradients(p, *args)
    for name in p:
        flat = np.flatnonzero(np.abs(g[name]).ravel() > 1e-6)[:4]
        for i in flat:
            old = p[name].ravel()[i]
            p[name].ravel()[i] = old + 1e-4
            up = toxicity.loss_and_gradients(p, *args)[0]
            p[name].ravel()[i] = old - 1e-4
            down = toxicity.loss_and_gradients(p, *args)[0]
            p[name].ravel()[i] = old
            assert abs((up - down) / 2e-4 - g[name].ravel()[i]) < 2e-3 * max(1, abs(g[name].ravel()[i])), name


def toxic_samples(n: int, seed: int):
    from tests.llm.conftest import prose

    rng = np.random.default_rng(seed)
    texts, y = [], []
    for i in range(n):
        words = prose(int(rng.integers(20, 150)), seed * 7919 + i).split()
        bad = i % 3 == 0
        if bad:
            for _ in range(3):
                words[int(rng.integers(len(words)))] = str(rng.choice(["grubbish", "snarkfool", "vilewretch", "grubbishly"]))
        texts.append(" ".join(words))
        y.append(float(bad))
    return texts, np.array(y, np.float32)


def test_toxicity_held_out(spark, awkward, empty):
    texts, y = toxic_samples(450, 1)
    model = toxicity.fit(texts, y, epochs=5)
    new, want = toxic_samples(240, 2)
    got = toxicity.score(spark.createDataFrame(list(enumerate(new)), "doc_id long, text string"), model).toPandas().sort_values("doc_id")
    assert np.mean(got.toxic.to_numpy() == (want > 0)) > 0.95
    assert (got.windows.to_numpy() == [max(1, -(-(len(t.split()) - 24) // 12) + 1) for t in new]).all()
    assert np.allclose(got.toxicity, toxicity.document_scores(model, new), atol=1e-5)
    rows = toxicity.score(awkward, model).collect()
    assert len(rows) == awkward.count()
    assert {r.doc_id for r in rows if r.windows == 0} == {2, 3, 4, None} and all(r.worst_word is None and r.toxicity == 0 for r in rows if r.windows == 0)
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.fit(texts[:5], np.ones(5)).threshold > 1


def slow_window(model, words):
    """The probability of one window: a step after another, a number after another."""
    p = {k: v.astype(np.float64) for k, v in model.p.items()}
    sig = lambda x: 1 / (1 + np.exp(-x))
    inputs = []
    for w in words:
        data = b"\x02" + w.encode() + b"\x03"
        tri = []
        for a, b, c in zip(data, data[1:], data[2:]):
            h = (a * 0x9E3779B1 & 0xFFFFFFFF) ^ (b * 0x85EBCA6B & 0xFFFFFFFF) ^ (c * 0xC2B2AE35 & 0xFFFFFFFF)
            tri.append((h * 0x27D4EB2F & 0xFFFFFFFF) >> 20)
        inputs.append(np.r_[p["words"][model.words.get(w, 0)], np.mean([p["chars"][t] for t in tri], axis=0) if tri else np.zeros(toxicity.CHAR_DIM)])
    states = np.zeros((len(words), 2, toxicity.HIDDEN))
    for d, places in ((0, range(len(words))), (1, reversed(range(len(words))))):
        h = np.zeros(toxicity.HIDDEN)
        for t in places:
            x, u = inputs[t] @ p["W"][d] + p["b"][d], h @ p["U"][d]
            z, r, k = (slice(i * toxicity.HIDDEN, (i + 1) * toxicity.HIDDEN) for i in range(3))
            update, reset = sig(x[z] + u[z]), sig(x[r] + u[r])
            h = (1 - update) * np.tanh(x[k] + reset * u[k]) + update * h
            states[t, d] = h
    flat = states.reshape(len(words), -1)
    a = np.exp(flat @ p["v"])
    return float(sig((a / a.sum()) @ flat @ p["w"] + p["c"][0]))


def test_scores_against_single_windows(spark):
    """The toxicity of a text is the greatest of its windows, each worked out alone in plain Python."""
    texts, y = toxic_samples(300, 1)
    model = toxicity.fit(texts, y, epochs=3)
    new = [*toxic_samples(25, 5)[0], "one", "Two WORDS.", "grubbish " * 30, "é ß 日本 snarkfool!"]
    for r in toxicity.score(spark.createDataFrame(list(enumerate(new)), "doc_id long, text string"), model).collect():
        words = [w.lower().strip(toxicity.EDGES) for w in new[r.doc_id].split()]
        starts = sorted({min(a, max(len(words) - toxicity.WINDOW, 0)) for a in range(0, max(len(words) - toxicity.WINDOW, 0) + toxicity.STRIDE, toxicity.STRIDE)})
        want = [slow_window(model, words[a : a + toxicity.WINDOW]) for a in starts]
        assert r.windows == len(starts) and abs(r.toxicity - max(want)) < 1e-4 and want[starts.index(r.worst_word)] > max(want) - 1e-4
        assert r.toxic == (r.toxicity >= model.threshold) or abs(max(want) - model.threshold) < 1e-4


def test_windows_cover_every_word():
    n = np.arange(0, 200)
    doc, start = toxicity.window_starts(n)
    for k in n:
        seen = np.zeros(k, bool)
        for s in start[doc == k]:
            seen[s : s + toxicity.WINDOW] = True
        assert seen.all()
