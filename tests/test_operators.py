"""Operators against small restatements in plain Python, and against hand-made cases."""

from __future__ import annotations

import gzip
import json
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import lexicons, limits, similarity
from quillon.functions import text as T
from quillon.operators import annotated as A
from quillon.operators import classify, language, lexrank, matching, ngrams, phrases, scoring, segment, sentences, tokens, topics, vectors, windows
from quillon.plans import catalog
from quillon.sources import checkpoints, corpus, dictionaries, documents, lines
from quillon.streaming import lines as stream

R = random.Random(5)
VOCAB = "risk loss fear gain calm the of and is bank rate".split()


def docs(spark, n=12, size=40):
    return spark.createDataFrame([(i, " ".join(R.choice(VOCAB) for _ in range(R.randrange(size)))) for i in range(n)], "doc_id long, text string").cache()


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


# columns


def test_text_columns(spark):
    df = spark.createDataFrame([("a  bb\tccc",), ("",), (None,)], "t string")
    got = df.select(T.tokens("t").alias("a"), T.split_on("t").alias("b"), T.drop_short("t", " ", 1).alias("c"), T.drop_short("t", n=None).alias("d"), T.one_line("t").alias("e"), T.first_code("t").alias("f")).collect()
    assert tuple(got[0]) == (["a", "bb", "ccc"], ["a", "", "bb\tccc"], "bb\tccc", "a  bb\tccc", "a bb ccc", 97)
    assert tuple(got[1]) == ([], [""], "", "", "", None)
    assert all(x is None for x in got[2])


def test_ids_and_ngrams(spark):
    df = spark.createDataFrame([("a_b_3",), ("x",), ("q_",)], "i string")
    assert [tuple(r) for r in df.select(T.document_part("i"), T.sentence_number("i")).collect()] == [("a_b", 3), (None, None), ("q", None)]
    grams = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "t array<string>").select(T.ngrams("t", 2).alias("g")).collect()
    assert [r.g for r in grams] == [[["a", "b"], ["b", "c"]], [], []]


def test_similarity_weights(spark):
    got = [r[0] for r in spark.createDataFrame([(0,), (9,), (99,)], "r int").select(T.similarity_weight("r")).collect()]
    assert np.allclose(got, [1 / math.log(2), 1 / math.log(11), 1 / math.log(101)])


def test_stop_words_of_all_languages(spark, tmp_path):
    """Every document has a row; words are dropped as plain Python would."""
    rows = [(1, "en", "The bank IS here"), (2, "fr", "Été à la forêt THE où"), (3, "de", "daß An ﬀ Über o\ufb00 maß"), (4, "zz", "и the は Δεν ıt ıs"), (5, None, "so née"), (6, "es", ""), (7, "es", None)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.tokens for r in catalog.queries()["without_stopwords"](spark, str(tmp_path)).collect()}
    assert got == {i: None if t is None else [w for w in t.split() if w.upper() not in lexicons.STOPWORDS_UPPER] for i, _, t in rows}
    assert got[3] == ["daß", "ﬀ", "Über", "maß"] and got[4] == ["и", "は", "Δεν"]


def test_word_lists():
    assert len(lexicons.STOPWORDS_UPPER) == 121 and len(lexicons.STOPWORDS) == 242 and len(lexicons.ENTITY_TAGS) == 12
    assert ("IN", "DT") in lexicons.STOP_TAG_PAIRS and ("NN", "DT") not in lexicons.STOP_TAG_PAIRS


# scores


def slow_scores(rows, dictionary, method, scale):
    counts = {d: {w: t.split().count(w) for w in set(t.split())} for d, t in rows.items()}
    df = {w: sum(w in c for c in counts.values()) for c in counts.values() for w in c}
    rank = {}
    for dim in sorted(dictionary):
        rank |= {w: i for i, w in enumerate(dictionary[dim])}
    out = {}
    for d, c in counts.items():
        n, values = sum(c.values()), []
        for dim in sorted(dictionary):
            v = 0.0
            for w in dictionary[dim]:
                if w in c:
                    x = {"TF": c[w], "WF": 1 + math.log(c[w])}[method[:2]] * (math.log(len(rows) / df[w]) if "IDF" in method else 1)
                    v += x / math.log(2 + rank[w]) if "SIM" in method else x
            values.append(None if scale and not n else v / n if scale else v)
        out[d] = (*values, n)
    return out


@pytest.mark.parametrize("method", ["TF", *scoring.METHODS])
@pytest.mark.parametrize("scale", [True, False])
def test_scores(spark, method, scale):
    df = docs(spark)
    own = {"bad": ["risk", "loss", "fear"], "good": ["gain", "fear"]}
    dic = spark.createDataFrame([(d, w, i) for d, ws in own.items() for i, w in enumerate(ws)], "dimension string, word string, rank int")
    got = scoring.tf_scores(df, dic, scale=scale) if method == "TF" else scoring.tfidf_scores(df, dic, method, scale=scale)
    assert got.columns == ["doc_id", "bad", "good", "document_length"]
    want = slow_scores(texts(df), own, method, scale)
    for r in got.collect():
        for x, y in zip(tuple(r)[1:], want[r.doc_id]):
            assert (x is None and y is None) or abs(x - y) < 1e-9


def test_scores_refuse_unknown_methods(spark):
    with pytest.raises(ValueError):
        scoring.weighted_terms(docs(spark), spark.createDataFrame([("a", "b", 0)], "dimension string, word string, rank int"), "TF")


def test_contribution_shares_add_up(spark):
    dic = spark.createDataFrame([("x", w, i) for i, w in enumerate(VOCAB[:5])], "dimension string, word string, rank int")
    rows = scoring.contribution_table(docs(spark), dic).collect()
    for m in ("TF", *scoring.METHODS):
        own = sorted((r.rank, r.share, r.cumulative_share) for r in rows if r.method == m)
        assert abs(sum(s for _, s, _ in own) - 1) < 1e-9 and abs(own[-1][2] - 1) < 1e-9


# matching


def slow_ratio(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return 200.0 * row[-1] / (len(a) + len(b)) if a or b else 100.0


def test_ratio():
    assert abs(similarity.indel_ratio("Noah Hodge", "Norma Hodges") - 81.818182) < 1e-5
    assert abs(similarity.indel_ratio("Brenda Hartman", "Brandy Hartman") - 85.714287) < 1e-5
    for _ in range(150):
        a, b = ("".join(R.choice("abcé ") for _ in range(R.choice([0, 3, 20, 63, 64, 65, 130, 200]))) for _ in range(2))
        assert abs(similarity.indel_ratio(a, b) - slow_ratio(a, b)) < 1e-9


def test_length_bound_loses_nothing():
    choices = ["".join(R.choice("abc") for _ in range(R.randrange(30))) for _ in range(80)]
    table = similarity.Choices(choices)
    for q in choices[:25]:
        i, r = table.ratios(q, 70.0)
        assert {choices[k] for k, x in zip(i, r) if x >= 70} == {c for c in choices if slow_ratio(q, c) >= 70 - 1e-9}


@pytest.mark.parametrize("scorer", ["ratio", "levenshtein"])
@pytest.mark.parametrize("groups", [[], ["g", "s"]])
def test_matches(spark, scorer, groups, monkeypatch):
    monkeypatch.setattr(matching, "QUERY_BLOCK", 5)
    monkeypatch.setattr(matching, "CHOICE_BLOCK", 7)
    word = lambda: "".join(R.choice("abcd") for _ in range(R.randrange(1, 8)))
    q = [(R.choice([1, 2, None]), R.choice("xy"), R.choice([word(), None])) for _ in range(40)]
    c = [(R.choice([1, 2, 3]), R.choice("xz"), word()) for _ in range(40)]
    qd, cd = spark.createDataFrame(q + q[:5], "g int, s string, a string"), spark.createDataFrame(c + c[:5], "g int, s string, b string")
    key = (lambda r: r[:2]) if groups else (lambda r: ())
    lev = lambda a, b: 100 * (1 - _levenshtein(a, b) / max(len(a), len(b)))
    score = slow_ratio if scorer == "ratio" else lev
    pairs = {(*key(x), x[2], y[2]): score(x[2], y[2]) for x in q if x[2] is not None and None not in key(x) for y in c if key(x) == key(y)}
    got = {tuple(r)[:-1]: r.match_score for r in matching.panel(qd, cd, "a", "b", groups, scorer).collect()}
    assert got.keys() == pairs.keys() and all(abs(got[k] - pairs[k]) < 1e-9 for k in got)
    best = {}
    for k, v in sorted(pairs.items(), key=lambda p: (-p[1], p[0][-1])):
        best.setdefault(k[:-1], []).append(k)
    assert {tuple(r)[:-1] for r in matching.best(qd, cd, "a", "b", groups, scorer).collect()} == {v[0] for v in best.values()}
    assert {tuple(r)[:-1] for r in matching.largest(qd, cd, "a", "b", 3, groups, scorer).collect()} == {k for v in best.values() for k in v[:3]}
    for method, test in matching.PREDICATES.items():
        assert {tuple(r)[:-1] for r in matching.within(qd, cd, "a", "b", 50.0, method, groups, scorer).collect()} == {k for k, v in pairs.items() if test(v, 50.0)}


def test_distances():
    pick = lambda: "".join(R.choice("abcé ") for _ in range(R.choice([0, 1, 3, 20, 63, 64, 65, 90])))
    table = similarity.Choices(choices := [pick() for _ in range(60)])
    for q in [pick() for _ in range(20)] + ["", "zz"]:
        at, value = table.levenshtein_ratios(q)
        assert sorted(at) == list(range(60))
        for i, d, v in zip(at, table.distances(q), value, strict=True):
            most = max(len(q), len(choices[i]))
            assert d == _levenshtein(q, choices[i]) and v == (100.0 * (1 - d / most) if most else 100.0)
    assert similarity.Choices([""]).distances("abc").tolist() == [3]


@pytest.mark.parametrize("scorer", ["ratio", "levenshtein"])
def test_links_are_the_counts_of_pairs(spark, scorer, monkeypatch):
    monkeypatch.setattr(matching, "QUERY_BLOCK", 5)
    monkeypatch.setattr(matching, "CHOICE_BLOCK", 7)
    word = lambda: "".join(R.choice("abc") for _ in range(R.randrange(1, 6)))
    q = spark.createDataFrame([(R.choice([1, 2, None]), R.choice([word(), None])) for _ in range(40)], "g int, a string")
    c = spark.createDataFrame([(R.choice([1, 2, 3]), word()) for _ in range(40)], "g int, b string")
    for method in matching.PREDICATES:
        pairs = matching.within(q, c, "a", "b", 50.0, method, ["g"], scorer).collect()
        got = matching.links(q, c, "a", "b", 50.0, method, ["g"], scorer)
        assert got.dtypes == [("g", "int"), ("origin_query", "string"), ("links", "bigint")]
        assert {(r.g, r.origin_query): r.links for r in got.collect()} == Counter((r.g, r.origin_query) for r in pairs)
    # the best are found in blocks, not by a join of all pairs
    plan = matching.best(q, c, "a", "b", ["g"], scorer)._jdf.queryExecution().optimizedPlan().toString()
    assert "levenshtein" not in plan and "FlatMapCoGroupsInPandas" in plan


def _words(alphabet, n, most, head=""):
    return [head + "".join(R.choice(alphabet) for _ in range(R.randrange(most + 1))) for _ in range(n)]


@pytest.mark.parametrize("alphabet", ["ab", "0123456789", "aé\0b😀"])
def test_tries_find_all_that_is_near(alphabet, monkeypatch):
    choices = sorted({*_words(alphabet, 60, 12, "x#"), *_words(alphabet, 20, 40), ""})
    queries = [*_words(alphabet, 12, 12, "y#"), *_words(alphabet, 8, 40), "", "a" * 65]
    scores = [sorted((-slow_ratio(q, c), i) for i, c in enumerate(choices)) for q in queries]
    for nodes, limit in ((1 << 14, 10**9), (16, 10**9), (16, 100)):
        monkeypatch.setattr(similarity.Tries, "NODES", nodes)
        tries = similarity.Tries(choices)
        tries.limit = limit
        for least, k in ((40.0, None), (72.0, None), (0.0, 1), (0.0, 4), (60.0, 2), (0.0, 1000)):
            own, at, value, given_up = tries.nearest(queries, least, k)
            assert len(queries) - 1 in given_up and (limit < 10**9 or len(given_up) == 1)
            for i in set(range(len(queries))) - set(given_up.tolist()):
                want = [(s, c) for s, c in scores[i] if least == 0 or -s >= least - 1e-9][:k]
                got = [(-v, c) for v, c in zip(value[own == i].tolist(), at[own == i].tolist())]
                assert [c for _, c in sorted(got)] == [c for _, c in want] and all(abs(x - y) < 1e-9 for (x, _), (y, _) in zip(sorted(got), want))


def test_search_looks_at_few_pairs():
    names = lambda head, n: [f"{head}#{i:09d}" for i in range(n)]
    spent = []
    for n in (1_000, 8_000):
        tries = similarity.Tries(names("Supplier", n))
        # a hundred names have the limit of one comparison with all, and none is given up
        tries.limit = 1_000
        assert not len(tries.nearest(names("Customer", 100), 72.0, None)[3])
        seen = []
        descend = tries._descend
        tries._descend = lambda *a: (descend(*a), seen.append(a[-1].sum()))[0]
        assert tries.nearest(names("Customer", 100), 72.0, None)[0].tolist() == list(range(100))
        spent.append(int(seen[-1]))
    assert spent[1] < 2 * spent[0]


@pytest.mark.parametrize("groups", [[], ["g"]])
def test_searched_blocks(spark, groups, monkeypatch):
    monkeypatch.setattr(matching, "SEARCH_QUERIES", 9)
    monkeypatch.setattr(matching, "SEARCH_CHOICES", 11)
    q = [(R.choice([1, 2]), w) for w in [*_words("abc", 30, 8), *_words("abc", 6, 90), "", "a" * 70]]
    c = [(R.choice([1, 2, 3]), w) for w in [*_words("abc", 30, 8), *_words("abc", 6, 90), "", "a" * 66]]
    qd, cd = spark.createDataFrame(q, "g int, a string"), spark.createDataFrame(c, "g int, b string")
    pairs = {(*x[: len(groups)], x[1], y[1]): slow_ratio(x[1], y[1]) for x in q for y in c if not groups or x[0] == y[0]}
    got = {tuple(r)[:-1]: r.match_score for r in matching.within(qd, cd, "a", "b", 60.0, "greater_equal", groups).collect()}
    assert got.keys() == {k for k, v in pairs.items() if v >= 60} and all(abs(got[k] - pairs[k]) < 1e-9 for k in got)
    best = {}
    for k, _ in sorted(pairs.items(), key=lambda p: (-p[1], p[0][-1])):
        best.setdefault(k[:-1], []).append(k)
    assert Counter(tuple(r)[:-1] for r in matching.largest(qd, cd, "a", "b", 4, groups).collect()) == Counter(k for v in best.values() for k in v[:4])


def test_own_scorer_and_first_group(spark):
    q = spark.createDataFrame([(1, "ab"), (2, "abc"), (2, "x")], "g int, a string")
    c = spark.createDataFrame([(1, "ab"), (2, "abd"), (2, "b")], "g int, b string")
    same = lambda a, b: (a.str.len() == b.str.len()) * 100.0
    assert {tuple(r) for r in matching.best(q, c, "a", "b", ["g"], same).collect()} == {(1, "ab", "ab", 100.0), (2, "abc", "abd", 100.0), (2, "x", "b", 100.0)}
    assert {r.g for r in matching.best(q, c, "a", "b", ["g"], drop_first_group=True).collect()} == {2}
    assert {(r.origin_query, r.match_list) for r in matching.within(q, c, "a", "b", 50.0, scorer=same).collect()} == {("ab", "ab"), ("abc", "abd"), ("x", "b")}
    with pytest.raises(ValueError):
        matching.best(q, c, "a", "b", scorer="other")


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_picks(spark):
    m = np.random.RandomState(0).rand(5, 5)
    df = spark.createDataFrame([(i, "ABCDE"[j], float(m[i, j])) for i in range(5) for j in range(5)], "row int, col string, value double")
    top = lambda **o: {(r.row, r.col, r.rank) for r in matching.pick_extremes(df, "row", "col", "value", **o).collect()}
    assert top(k=3) == {(i, "ABCDE"[j], r + 1) for i in range(5) for r, j in enumerate(np.argsort(-m[i])[:3])}
    assert top(k=2, largest=False) == {(i, "ABCDE"[j], r + 1) for i in range(5) for r, j in enumerate(np.argsort(m[i])[:2])}
    assert top(k=3, axis=0) == {(i, "ABCDE"[j], r + 1) for j in range(5) for r, i in enumerate(np.argsort(-m[:, j])[:3])}
    assert len(top(k=9)) == 25
    assert {(r.row, r.col) for r in matching.pick_threshold(df, "value", 0.6, "greater").collect()} == {(i, "ABCDE"[j]) for i, j in zip(*np.nonzero(m > 0.6))}
    odd = spark.createDataFrame([(0, "A", float("nan")), (0, "B", None), (0, "C", 1.0)], "row int, col string, value double")
    assert [r.col for r in matching.pick_threshold(odd, "value", 0.0).collect()] == ["C"]
    assert matching.pick_extremes(odd, "row", "col", "value", 1).first().col == "C"


# windows


def slow_windows(own, patterns, w, merge):
    hits = [i for i in range(len(own) - w + 1) if all(any(re.search(p, s, re.I) for s in own[i : i + w]) for p in patterns)]
    if not merge:
        return [(i, i + w) for i in hits]
    out = []
    for i in hits:
        if out and i < out[-1][1]:
            out[-1] = (out[-1][0], i + w)
        else:
            out.append((i, i + w))
    return out


@pytest.mark.parametrize("merge", [True, False])
def test_paragraphs(spark, merge):
    rows = [(i, ["".join(R.choice("Ab cd") for _ in range(6)) for _ in range(R.randrange(14))]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, sentences array<string>")
    got = {tuple(r) for r in windows.paragraph_windows(df, ["a", "d"], 3, merge).collect()}
    assert got == {(d, a, b) for d, own in rows for a, b in slow_windows(own, ["a", "d"], 3, merge)}
    with pytest.raises(ValueError):
        windows.paragraph_windows(df, [], 3)


def slow_topics(text, table, subject, n, w, binary):
    words = text.split(" ")
    grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
    count = weight = score = 0
    for i in range(len(grams) - w):
        window = grams[i : i + w + 1]
        x = table.get(window[w // 2])
        if x is not None:
            near = len({y for g in window for y in g} & subject)
            count, weight, score = count + 1, weight + x, score + x * (min(near, 1) if binary else near)
    return len(words), sum(v in subject for v in words), count, weight, score


@pytest.mark.parametrize("n,w", [(2, 20), (1, 4), (3, 5)])
@pytest.mark.parametrize("binary", [True, False])
def test_topic_windows(spark, n, w, binary):
    sizes = [0, 1, 21, 22, 23, 60, 90]
    rows = [(i, " ".join(R.choice(VOCAB) for _ in range(k))) for i, k in enumerate(sizes)]
    table = {tuple(R.choice(VOCAB) for _ in range(n)): float(i + 1) for i in range(30)}
    subject = {"risk", "loss", "fear"}
    out = windows.topic_windows(spark.createDataFrame(rows, "doc_id long, text string"), {"t": table}, {"s": subject}, n, w, ["s"] if binary else [], scale=False, multiplier=1)
    for r in out.collect():
        assert np.allclose(tuple(r)[1:], slow_topics(rows[r.doc_id][1], table, subject, n, w, binary))


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_ngrams_across_rows(spark, n):
    rows = [(i, [R.choice("abc") for _ in range(R.randrange(4))]) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, tokens array<string>").repartition(5)
    flat = [w for _, t in rows for w in t]
    want: dict = {}
    for k in range(len(flat) - n + 1):
        want[tuple(flat[k : k + n])] = want.get(tuple(flat[k : k + n]), 0) + 1
    got = {tuple(r.ngram): r.score for r in ngrams.ngram_dictionary(df, n=n, scorer="count", by="all", order_cols=["i"]).collect()}
    assert got == want


def test_ngrams_reject_tags_and_words(spark):
    df = spark.createDataFrame([([("a", "IN"), ("b", "DT"), ("c", "NN"), ("I", "NN"), ("d", "NN")],)], "tokens array<struct<word:string,pos:string>>")
    rows = ngrams.ngram_dictionary(df).collect()
    assert [(r.ngram, r.score, r.total) for r in rows] == [(["b", "c"], 1.0, 1)]
    assert ngrams.ngram_dictionary(df, n=9).count() == 0


# annotated lines


def slow_clean(line, rules):
    """The cleaner in plain Python: masks by token and part."""
    out = []
    seen = False
    for tok in line.strip().split(" "):
        if not seen and re.fullmatch(r"\[SENTIMENT:(.+?)\]", tok, re.I):
            seen = True
            continue
        parts = []
        for f in tok.split("[SEP]"):
            ner, pos = re.match(r"\[NER:(.+?)\]", f, re.I), None
            f = f[ner.end() :] if ner else f
            pos = re.search(r"^(.*)\[POS:(.+?)\]$", f, re.I)
            parts.append([ner[1] if ner else "", pos[2] if pos else "", pos[1] if pos else f])
        full = "".join(p[2] for p in parts)
        whole = not (rules.longer_than is not None and len(full) <= rules.longer_than)
        if rules.composition == "contains_alphabet_only":
            whole &= full.isalpha()
        if len(parts) == 1 and full.upper() in {w.upper() for w in (*rules.stopwords, *rules.punctuation)}:
            whole = False
        masks = [[whole] * 3 for _ in parts]
        n = 0
        for i, p in enumerate(parts):
            if rules.most_ner_tags is not None and n >= rules.most_ner_tags:
                masks[i][0] = False
            n += p[0] != ""
        for options, k, spread in ((rules.ner, 0, True), (rules.pos, 1, False)):
            for option, which in options.items():
                for i, p in enumerate(parts):
                    if p[k] != "" if which == "all" else p[k].upper() in {w.upper() for w in which}:
                        for j in range(i, len(parts) if spread else i + 1):
                            if option != "removes_original_text":
                                masks[j][k] = False
                            if option != "removes_tags":
                                masks[j][2] = False
        done = []
        for p, m in zip(parts, masks):
            ner, pos, t = (v if ok else "" for v, ok in zip(p, m))
            done.append((f"[NER:{ner}]" if ner else "") + t + (f"[POS:{pos}]" if pos else ""))
        out.append(rules.joined_parts.join(x for x in done if x))
    return rules.joined_tokens.join(x for x in out if x)


@pytest.mark.parametrize(
    "rules",
    [
        A.Rules(),
        A.CORPUS_RULES,
        A.Rules(ner={"removes_tags_and_original_text": ["PERSON"]}, pos={"removes_original_text": ["DT"]}),
        A.Rules(most_ner_tags=1, longer_than=2, joined_parts="_"),
        A.Rules(most_ner_tags=0, composition="contains_alphabet_only", stopwords=("the",), punctuation=(".",)),
        A.Rules(ner={"removes_tags": "all", "removes_original_text": ["ORG"]}, pos={"removes_tags": "all"}),
    ],
)
def test_cleaner(spark, rules):
    part = lambda: R.choice(["", "[NER:PERSON]", "[NER:ORG]"]) + R.choice(["the", "ab", "Ünï", "x1", ".", "[POS:a]b"]) + R.choice(["", "[POS:NN]", "[POS:DT]", "[POS:.]"])
    rows = [" ".join("[SEP]".join(part() for _ in range(R.choice([1, 1, 2, 3]))) for _ in range(R.randrange(7))) for _ in range(60)]
    rows += ["[SENTIMENT:Good] " + r for r in rows[:20]] + ["", "a [SENTIMENT:x] [SENTIMENT:y]"]
    got = spark.createDataFrame([(r,) for r in rows], "text string").select("text", A.clean_line("text", rules).alias("c"), A.render(A.parse("text")).alias("same"), A.sentiment("text").alias("s")).collect()
    for r in got:
        assert r.c == slow_clean(r.text, rules), r.text
        m = next((t for t in r.text.split(" ") if re.fullmatch(r"\[SENTIMENT:(.+?)\]", t)), None)
        assert r.s == (m[11:-1] if m else "")


def test_topic_tables_of_thousands(spark):
    """Large tables of n-grams and of words are looked up by checksum."""
    words = [f"w{i}" for i in range(900)]
    table = {(R.choice(words), R.choice(words)): float(i % 7 + 1) for i in range(4000)}
    subject = set(words[:400])
    rows = [(i, " ".join(R.choice(words) for _ in range(400))) for i in range(10)] + [(10, " ".join(f"{a} {b}" for a, b in list(table)[:300]))]
    out = windows.topic_windows(spark.createDataFrame(rows, "doc_id long, text string"), {"t": table}, {"s": subject}, scale=False, multiplier=1)
    got = {r.doc_id: tuple(r)[1:] for r in out.collect()}
    assert all(np.allclose(got[i], slow_topics(t, table, subject, 2, 20, False)) for i, t in rows) and got[10][2] > 100


ODD = ["[NER:]x", "[ner:a]b", "[NER:a]]b[POS:]", "x[POS:NN]\n", "x[POS:NN]\r\n", "x[POS:a][POS:b]", "[POS:NN]", "a]", "[", "]", "[NER:PERSON]", "ſ[PoS:x]", "[SENTIMENT:a]b", "[sentiment:q]\n", "ab\n", "ab\n\n", "ab\u2028", "½", "x²", "é́", "ΑΣ", "İx", "𞤀𞤁", "Ა", "ﬁ", "K[POS:K]", "漢字", "😀", "", "[SEP]", "[NER:ORG][POS:.][SEP]", "a[SEP]", "[x]y[NER:a]", "[NER:a\n]b[POS:c\n]"]


def _odd_lines():
    part = lambda: R.choice(["", "", "[NER:PERSON]", "[NER:ORG]"]) + R.choice(["the", "ab", "Ünï", "x1", ".", *ODD]) + R.choice(["", "[POS:NN]", "[POS:DT]", "[POS:.]"])
    rows = [" ".join("[SEP]".join(part() for _ in range(R.choice([1, 1, 2, 3]))) for _ in range(R.randrange(6))) for _ in range(300)]
    return [*ODD, *rows, *("[SENTIMENT:Good] " + r for r in rows[:40]), " a  b ", None]


@pytest.mark.parametrize(
    "rules",
    [
        A.Rules(),
        A.CORPUS_RULES,
        A.NGRAM_RULES,
        A.Rules(composition="contains_alphabet_or_number_only", most_ner_tags=1, joined_parts=""),
        A.Rules(composition="contains_number", ner={"removes_tags_and_original_text": ["person"]}, pos={"removes_original_text": ["DT"], "removes_tags": ()}),
        A.Rules(composition="contains_number_only", part_sep="x", joined_tokens="__"),
        A.Rules(lower_case=True, composition="contains_alphabet", sentiment_label="É", longer_than=0, punctuation=(".",)),
    ],
)
def test_batches_are_cleaned_like_lines(spark, rules):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(_odd_lines())], "i int, text string")
    want = df.select("i", "text", A.clean_line("text", rules).alias("c"), T.drop_short(A.clean_line("text", rules), rules.joined_tokens, 2).alias("p"))
    got = A.clean(df, rules).withColumnRenamed("text", "c2").join(A.preprocess(df, rules, collapse=False, piece_longer_than=2).withColumnRenamed("text", "p2"), "i")
    for r in want.join(got, "i").collect():
        assert (r.c2, r.p2) == (r.c, r.p), r.text
    # the expressions are left for lines with rare signs; a batch does the others
    for own in (A.preprocess(df, rules), A.clean(df, rules)):
        assert "ArrowEvalPython" in own._jdf.queryExecution().executedPlan().toString()
    clean = A.line_cleaner(rules, 2)
    for r in want.where("text IS NOT NULL").collect():
        if r.text.isascii():
            assert clean(r.text.lower() if rules.lower_case else r.text) == r.p, r.text


def test_cleaner_refuses_wrong_rules():
    for wrong in ({"composition": "x"}, {"longer_than": True}, {"ner": {"x": "all"}}):
        with pytest.raises(ValueError):
            A.Rules(**wrong)


def test_lower_case_and_preprocess(spark):
    df = spark.createDataFrame([("[NER:Person]Big[POS:NN]  BANK[POS:NN] the[POS:DT] 12 a",)], "text string")
    assert A.preprocess(df).first().text == "big bank"


def test_rendered_sentences(spark):
    toks = [(0, "New", "new", "NNP", "LOC"), (1, "York", "york", "NNP", "LOC"), (2, "is", "be", "VB", "O")]
    df = spark.createDataFrame([(toks, [(0, 2, "CITY")], [(1, 3, "nsubj"), (2, 1, "compound")])], "t array<struct<at:int,text:string,lemma:string,pos:string,ner:string>>, m array<struct<start:int,end:int,type:string>>, d array<struct<source:int,target:int,dep:string>>")
    joins = A.edge_sources(F.concat(A.mention_edges("m"), A.dependency_edges("d", F.lit(0))))
    got = df.select(A.render_sentence("t", joins, "m", sentiment=F.lit("Neutral")).alias("x"), A.render_sentence("t", joins, lemma=False, pos=False).alias("y")).first()
    assert got.x == "[SENTIMENT:Neutral] [NER:CITY]new[POS:NNP][SEP]york[POS:NNP] be[POS:VB] " and got.y == "New[SEP]York is "


def test_rules_of_annotation(spark):
    df = spark.createDataFrame([(1, "The parties walked to 3 boxes, classes and buses in 1999. They paid $ 20 or 5 % to Paris. good day. a bad fear")], "doc_id long, text string")
    own = sentences.nested(df).first().sentences
    word = {w.text: w for s in own for w in s.words}
    assert [word[w].lemma for w in ("parties", "walked", "boxes", "classes", "buses", "The", "paid")] == ["party", "walk", "box", "class", "buse", "the", "paid"]
    assert [word[w].ner for w in ("3", "1999", "20", "%", "Paris", "They", "or")] == ["NUMBER", "DATE", "MONEY", "PERCENT", "MISC", "O", "O"]
    assert [s.sentiment for s in own] == ["Neutral", "Neutral", "Positive", "Negative"]


def test_attributes_that_are_asked_for(spark):
    odd = "Running flies only ugly Ǆabc ing ly ß Straße x1 1999 $ 20 % 5 _a ½ good bad GOOD classes Ties é boxing İx"
    df = spark.createDataFrame([(1, odd + ". good. bad day\nGood bad"), (2, ""), (3, None)], "doc_id long, text string")
    full = {r.doc_id: r.sentences for r in sentences.nested(df).collect()}
    for sent, word in ((["text"], []), (["sentiment"], []), (["words"], ["lemma"]), (["sentiment", "words"], ["pos", "at"])):
        part = {r.doc_id: r.sentences for r in sentences.nested(df, attributes=sent, word_attributes=word).collect()}
        assert part[3] is None and part[2] == []
        for a, b in zip(full[1], part[1], strict=True):
            assert list(b.asDict()) == sent
            assert all(b[x] == a[x] for x in sent if x != "words")
            if "words" in sent:
                assert [w.asDict() for w in b.words] == [{x: w[x] for x in word} for w in a.words]
    words = full[1][0].words
    plain = spark.createDataFrame([(w.at, w.text, words[w.at - 1].text if w.at else "") for w in words], "at int, w string, b string")
    rules = plain.select("at", sentences.lemma(F.col("w")), sentences.shape_tag(F.col("w")), sentences.entity_tag(F.col("w"), F.col("b"))).collect()
    assert sorted(tuple(r) for r in rules) == [(w.at, w.lemma, w.pos, w.ner) for w in words]
    assert [s.sentiment for s in full[1]] == ["Neutral", "Positive", "Negative", "Neutral"]
    with pytest.raises(ValueError):
        sentences.nested(df, attributes=["tone"])


def test_sentences_and_annotator(spark):
    df = spark.createDataFrame([(1, "A b. C d!\n e"), (2, ""), (3, None)], "doc_id long, text string")
    assert [(r.sent_id, r.text) for r in sentences.split_sentences(df).orderBy("sent_id").collect()] == [("1_0", "A b"), ("1_1", "C d!"), ("1_2", "e")]

    def annotator():
        def run(text):
            if text == "":
                raise RuntimeError("nothing")
            return [s.upper() for s in text.split(".")]

        return run

    got = {r.sent_id: (r.text, r.error) for r in sentences.annotate(df, annotator).collect()}
    assert got["1_0"] == ("A B", None) and got["2_0"] == ("", "RuntimeError: nothing")
    back = {r.doc_id: (r.text, r.n_sentences) for r in tokens.regroup_sentences(sentences.split_sentences(df)).collect()}
    assert back == {"1": ("A b C d! e", 3)}
    nested = sentences.nested(df)
    assert sentences.word_attribute(nested, "lemma").first()["values"] == [["a", "b"], ["c", "d", "!"], ["e"]]
    assert json.loads(sentences.dump_sentences(nested).first().words_json)[0]["text"] == "A"


# models


def test_phrases(spark):
    rows = ["new york is far"] * 20 + ["bank of america wins", "new york new york"] * 15 + ["a b"]
    df = spark.createDataFrame([(r,) for r in rows], "text string")
    model = phrases.fit(df, 0.05, 5, ["of"])
    assert {(r["first"], *r.middle, r.second) for r in model.collect()} >= {("new", "york"), ("bank", "of", "america")}
    out = [r.text for r in phrases.apply(df, model.where("first in ('new', 'bank')"), ["of"]).collect()]
    assert "new_york is far" in out and "bank_of_america wins" in out and "new_york new_york" in out


def slow_join(words, known, between, sep):
    out, pending = [], []
    for w in words:
        if pending and w in between:
            pending.append(w)
        elif pending and (*pending, w) in known:
            out.append(sep.join([*pending, w]))
            pending = []
        elif w in between:
            out, pending = [*out, *pending, w], []
        else:
            out, pending = out + pending, [w]
    return out + pending


@pytest.mark.parametrize("most", [1 << 20, 8])
def test_phrases_against_a_walk(spark, most, monkeypatch):
    """All phrases at once, or in passes of one or two, as a walk from word to word joins them."""
    monkeypatch.setattr(phrases, "PASS_BYTES", most)
    between = ["of", "the"]
    known = {("a", "b"), ("b", "a"), ("a", "a"), ("b", "of", "c"), ("a", "of", "the", "b"), ("c", "the", "c")}
    rows = [(i, R.choice([None, "", *[" ".join(R.choice(["a", "b", "c", "of", "the"]) for _ in range(R.randrange(20))) for _ in range(8)]])) for i in range(200)]
    table = spark.createDataFrame([(k[0], list(k[1:-1]), k[-1]) for k in known], "first string, middle array<string>, second string")
    got = texts(phrases.apply(spark.createDataFrame(rows, "doc_id long, text string"), table, between))
    assert got == {i: None if t is None else " ".join(slow_join(t.split(), known, between, "_")) for i, t in rows}


def test_language_by_shuffle(spark, monkeypatch):
    df = spark.createDataFrame([(i, t, t[:1]) for i, t in enumerate(["a banana", "b kiwi kiwi", "a ananas", "b wiki", "b"])], "doc_id long, text string, lang string")
    found = lambda: sorted((r.doc_id, [(x.lang, round(x.prob, 9)) for x in r.languages]) for r in language.detect(df, language.fit(df), "all_prob").collect())
    want = found()
    monkeypatch.setattr(language, "small", lambda df: False)
    assert found() == want


def test_language_held_out(spark):
    import os

    path = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no tables")
    df = spark.read.parquet(path)
    model = language.fit(df.where("doc_id % 2 = 0"), rows=2000)
    test = df.where("doc_id % 2 = 1 and n_chars > 100")
    got = language.detect(test, model).join(test, "doc_id").select((F.col("languages") == F.col("lang")).cast("int").alias("ok")).agg(F.avg("ok")).first()[0]
    assert got > 0.95
    full = language.detect(test, model, "all_prob").first().languages
    assert abs(sum(p.prob for p in full) - 1) < 1e-6 and [p.prob for p in full] == sorted((p.prob for p in full), reverse=True)
    with pytest.raises(ValueError):
        language.detect(df, model, "best")


def test_language_of_many_characters(spark):
    """A model of more than 20,000 n-grams keeps those of the rare language."""
    wide = [chr(0x4E00 + i) for i in range(20_500)]
    rows = [(i, "".join(wide[i * 500 : i * 500 + 500]) * 2, "zh") for i in range(41)] + [(100, "ξένος λόγος", "el")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df)
    assert model.where("gram is not null").select("gram").distinct().count() > 20_000
    total, size = len("ξένος λόγος") + 1, model.where("gram is not null").select("gram").distinct().count()
    assert abs(model.where("lang = 'el' and gram = 'ος'").first().log_p - math.log(2.5 / (total + size / 2))) < 1e-9
    got = {r.doc_id: r.languages for r in language.detect(df, model).collect()}
    assert got[100] == "el" and all(got[i] == "zh" for i in range(41))


def test_lexrank(spark):
    m = np.array([[1, 0.5, 0.2], [0.5, 1, 0.1], [0.2, 0.1, 1]])
    p = m / m.sum(1, keepdims=True)
    values, left = np.linalg.eig(p.T)
    v = np.real(left[:, np.argmax(values.real)])
    assert np.allclose(lexrank.centrality(m), v / v.sum() * 3, atol=1e-4)
    assert abs(lexrank.centrality(m, 0.3).sum() - 3) < 1e-6
    with pytest.raises(ValueError):
        lexrank.centrality(m, 1.5)
    df = spark.createDataFrame([(1, ["the bank fell", "the bank rose", "birds sing"]), (2, [])], "doc_id long, sentences array<string>")
    top = lexrank.summary(lexrank.lexrank(df), 1).collect()
    assert len(top) == 1 and "bank" in top[0].sentence


def test_centrality_without_the_matrix(spark, monkeypatch):
    """A row's share of the sum is where power iteration ends, whatever the blocks."""
    for n in (0, 1, 2, 40):
        own = [" ".join(R.choice("a b c dd e f g the of".split()) for _ in range(R.randrange(9))) for _ in range(n)] + ["the", ""][: n and 2]
        for threshold in (None, 0.3, 0.0):
            want = lexrank.centrality(lexrank.sentence_similarity(own), threshold)
            for block in (1 << 22, 60):
                monkeypatch.setattr(lexrank, "BLOCK", block)
                assert np.allclose(lexrank.sentence_centrality(own, threshold), want, atol=1e-4)
    assert np.allclose(lexrank.sentence_centrality(["the bank", "the bank"]), [1, 1])


def test_topics(spark, monkeypatch):
    rows = [(i, "apple pear plum fruit" if i % 2 else "steel iron coal mine") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = topics.fit(df, topics=2, iterations=20, alpha=1.0)
    own = topics.transform(df, model)
    assert all(abs(sum(r.topics) - 1) < 1e-9 for r in own.collect())
    best = {r.doc_id: r.topic for r in topics.top_topic(own).collect()}
    assert len({best[i] for i in range(0, 40, 2)}) == len({best[i] for i in range(1, 40, 2)}) == 1 and best[0] != best[1]
    assert topics.topic_words(model, 3).count() == 6 and topics.top_documents(own, 3).count() == 6
    p = lambda m: np.array([(r.p0, r.p1) for r in m.words.orderBy("word_id").collect()])
    assert np.allclose(p(model).sum(0), 1) and abs(sum(model.theta) - 1) < 1e-9
    monkeypatch.setattr(topics, "BROADCAST_BYTES", 0)  # all by shuffle
    again = topics.fit(df, topics=2, iterations=20, alpha=1.0)
    assert np.allclose(p(again), p(model)) and np.allclose(again.theta, model.theta)


@pytest.mark.parametrize("step", [1, 40, 1 << 18])
def test_biterms_without_a_shuffle_of_pairs(spark, monkeypatch, step):
    monkeypatch.setattr(topics, "STEP", step)
    own = [(1, "a b a c"), (2, ""), (3, "x"), (4, None), (5, " ".join(R.choice("abcde") for _ in range(200))), (5, "a b c d e f"), (None, "p q p")]
    df = spark.createDataFrame(own, "doc_id long, text string")
    for least in (1, 2):
        vocab = topics.vocabulary(df, least)
        codes = {r.word: r.word_id for r in vocab.collect()}
        want = Counter()
        words = [(i, p, codes[w]) for i, t in own for p, w in enumerate((t or "").split()) if w in codes]
        for i, p, x in words:
            for j, q, y in words:
                if i == j and 1 <= q - p <= 14:
                    want[i, min(x, y), max(x, y)] += 1
        out = topics.biterms(df, vocab)
        assert out.dtypes == [("doc_id", "bigint"), ("a", "bigint"), ("b", "bigint"), ("n", "bigint")]
        assert {(r.doc_id, r.a, r.b): r.n for r in out.collect()} == want and out.count() == len(want)
    # pairs don't travel: no exchange lies above where they are made
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan and "Window" not in plan.split("MapInArrow")[0]


def test_word_vectors(spark):
    df = spark.createDataFrame([(" ".join(R.choice(VOCAB) for _ in range(8)),) for _ in range(60)], "text string")
    a, b = (vectors.train(df, 8, min_count=2, seed=3).orderBy("word").collect() for _ in range(2))
    assert a == b and {r.word for r in a} <= set(VOCAB) and len(a[0].vector) == 8


@pytest.mark.parametrize("name", ["sentence_tones", "parsed_annotations", "cleaned_annotations", "preprocessed_annotations"])
def test_documents_without_words_are_as_in_sql(spark, tmp_path, name):
    import duckdb

    rows = [(0, ""), (1, None), (2, " . \n."), (3, "a good thing. bad"), (4, " ")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = catalog.queries()[name](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.oracle_sql()[name]}) ORDER BY doc_id").fetchall()
    assert [tuple(r) for r in got.orderBy("doc_id").collect()] == want


def test_similarities_have_the_bits_of_the_sql_engine(spark):
    """Two seeds are equally near to their mean, so that their order hangs on the last bit."""
    import duckdb

    r = random.Random(5)
    vecs = {f"w{i}": [r.gauss(0, 1) for _ in range(64)] for i in range(40)}
    df = spark.createDataFrame(list(vecs.items()), "word string, vector array<float>")
    seeds = {f"d{i}": [f"w{2 * i}", f"w{2 * i + 1}"] for i in range(20)}
    got = {(x.dimension, x.word): x.similarity for x in vectors.similarities(df, vectors.seeds_frame(spark, seeds)).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE v (word VARCHAR, e DOUBLE[])")
    con.executemany("INSERT INTO v VALUES (?, ?)", [(x.word, list(x.vector)) for x in df.collect()])
    for d, (a, b) in seeds.items():
        want = con.execute(
            """WITH u AS (SELECT i, e[i] / sqrt(list_sum(list_transform(e, lambda x: x * x))) AS x FROM (SELECT e, unnest(range(1, 65)) AS i FROM v WHERE word IN (?, ?))),
            c AS (SELECT list(x ORDER BY i) AS c FROM (SELECT i, avg(x) AS x FROM u GROUP BY i)) SELECT word, list_cosine_similarity(e, c) FROM v, c""",
            [a, b],
        ).fetchall()
        assert {w: got[d, w] for w, _ in want} == dict(want)
    odd = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0]), ([1.0, None], [1.0, 0.0]), ([1.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [x[0] for x in odd.select(vectors.cosine("a", "b")).collect()] == [1.0, None, None, None, None]


def test_word_vectors_are_made_by_tasks(spark, monkeypatch):
    """No process holds all vectors: chunks are trained by themselves and words of several chunks meet by their means."""
    monkeypatch.setattr(vectors, "CHUNK", 5_000)
    r = random.Random(2)
    kinds = [f"a{i}" for i in range(10)], [f"b{i}" for i in range(10)]
    rows = [(" ".join(r.choice(kinds[k % 2]) for _ in range(30)),) for k in range(2_000)] + [("x " * 2_000,), (None,), ("",), ("rare",)]
    df = spark.createDataFrame(rows, "text string").repartition(3)
    out = vectors.train(df, 20, epochs=3, partitions=3)
    assert "MapInArrow" in out._jdf.queryExecution().optimizedPlan().toString()
    got = out.collect()
    vec = {x.word: np.array(x.vector) for x in got}
    assert {x.word: x.n for x in got} == {w: n for w, n in Counter(w for (t,) in rows for w in (t or "").split()).items() if n >= 5}
    assert all(np.isfinite(v).all() and len(v) == 20 for v in vec.values())
    cos = lambda a, b: vec[a] @ vec[b] / np.linalg.norm(vec[a]) / np.linalg.norm(vec[b])
    alike = np.mean([cos(a, b) for own in kinds for a in own for b in own if a != b])
    assert alike > 0.05 + np.mean([cos(a, b) for a in kinds[0] for b in kinds[1]])


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_vague_hits_search_tokens_where_they_are(spark, monkeypatch):
    rows = [(1, "other others the of x"), (2, "ere there there"), (2, "there"), (3, ""), (4, None)]
    df, dic = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("a", "er"), ("a", "the"), ("b", "er"), ("b", "zz")], "dimension string, word string")
    few = scoring.counted_hits(df, dic, vague=True)
    assert "Join" not in _plan(few)
    monkeypatch.setattr(scoring, "PARTS", 1)
    every = [sorted((r.doc_id, r.word, r.n, tuple(sorted(r.dimensions))) for r in x.collect()) for x in (few, scoring.counted_hits(df, dic, vague=True))]
    assert every[0] == every[1] == [(1, "other", 1, ("a", "b")), (1, "others", 1, ("a", "b")), (1, "the", 1, ("a",)), (2, "ere", 1, ("a", "b")), (2, "there", 3, ("a", "b"))]


def test_tfidf_vectors_of_repeated_ids_and_of_one_row_each(spark):
    rows = [(1, "a b b c"), (2, "a c"), (3, ""), (4, None), (5, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = tokens.tfidf_vectors(df)
    assert "MapInArrow" in _plan(out) and "Join LeftOuter" not in _plan(out) and _plan(out).count("Aggregate") <= 2
    same = tokens.tfidf_vectors(df.union(spark.createDataFrame([(1, None)], df.schema)))
    assert "MapInArrow" not in _plan(same)
    got = [sorted((r.doc_id, r.word, round(r.weight, 9)) for r in x.collect()) for x in (out, same)]
    assert got[0] == got[1] and [g[:2] for g in got[0]] == [(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "c"), (5, "d")]


def test_similarity_matrix_joins_no_pairs(spark):
    x = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "z"), (None, "a")], "doc_id long, text string")
    y = spark.createDataFrame([(7, "a"), (8, "b q"), (None, "q")], "doc_id long, text string")
    out = tokens.similarity_matrix(x, y)
    assert "Join LeftOuter, ((x" not in _plan(out)
    assert out.count() == 12 and {(r.x, r.y) for r in out.where("score > 0").collect()} == {(1, 7), (1, 8)}


@pytest.mark.parametrize("n", [2, 3, 4])
def test_languages_in_batches_are_those_of_plain_sums(spark, n):
    rows = [(i, " ".join(R.choice(("the", "of", "and") if i % 2 else ("der", "die", "straße", "𝒳" if n < 4 else "x")) for _ in range(5)), "en" if i % 2 else "de") for i in range(40)]
    df = spark.createDataFrame([*rows, (50, "", None), (51, None, None), (52, "??", None), (0, "the the the", None)], "doc_id long, text string, lang string")
    model = language.fit(df, n=n)
    grams = lambda t: [f" {t} "[i : i + n] for i in range(len(t) + 3 - n)]
    count = {x: Counter(g for _, t, lang in rows if lang == x for g in grams(t)) for x in ("en", "de")}
    size = len(set(count["en"]) | set(count["de"]))
    p = {(r.lang, r.gram): r.log_p for r in model.collect()}
    assert all(abs(p[x, g] - math.log((c + 0.5) / (sum(count[x].values()) + 0.5 * size))) < 1e-9 for x in count for g, c in count[x].items())
    got = {r.doc_id: r.languages for r in language.detect(df, model, "max", n).collect()}
    assert len(got) == 43 and got[51] is got[52] is None and all(got[i] == lang for i, _, lang in rows if i)
    assert n > 3 or "Generate" not in _plan(language.detect(df, model, "max", n))


@pytest.mark.parametrize("n", [1, 2, 3])
def test_ngrams_are_counted_in_batches(spark, n, monkeypatch):
    rows = [(i, [R.choice(["the", "a", "bb", "cc", "İt", "é"]) for _ in range(i % 5)]) for i in range(60)] + [(60, None), (61, ["bb"] * 6)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>").repartition(3)
    out = ngrams.ngram_dictionary(df, n=n, scorer="count", stop_words=("A",))
    assert "Generate" not in _plan(out)
    own = lambda t: [tuple(t[i : i + n]) for i in range(len(t) - n + 1) if "a" not in t[i : i + n]]
    assert {tuple(r.ngram): r.score for r in out.collect()} == Counter(g for _, t in rows for g in own(t or []))
    across = ngrams.ngram_dictionary(df, n=n, scorer="count", by="all", order_cols=["id"], stop_words=("a",), longer_than=1)
    assert {tuple(r.ngram): r.score for r in across.collect()} == Counter(own([w for _, t in rows for w in t or [] if len(w) > 1]))


def test_letters_joined_by_all_words(spark, tmp_path):
    """Words beyond the 10,000 commonest are joined too, by the ranks that a plain sort gives."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    many = sorted({"".join(R.choice(letters) for _ in range(6)) for _ in range(10_500)})
    rows = [(0, " ".join(many)), (1, " ".join(many)), (2, "zebraish the forêt"), (3, "the"), (4, "a z e b r a i s h b"), (5, "x t h e f o r ê t x"), (6, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = texts(catalog.queries()["joined_letters"](spark, str(tmp_path)))
    df = {}
    for _, t in rows:
        for w in set((t or "").split()):
            df[w] = df.get(w, 0) + 1
    order = sorted((w for w in df if w.isalpha()), key=lambda w: (-df[w], w.encode()))
    whole = segment.Words(order)
    assert order.index("zebraish") > 10_000 and "zebraish" in got[4].split() and "forêt" in got[5].split()
    assert got == {i: None if t is None else whole.join_letters(t) for i, t in rows}
    counts = spark.createDataFrame(list(df.items()), "word string, df long").where("word rlike '^\\\\p{L}+$'")
    assert {r.word: r["rank"] for r in segment.ranked(counts, counts.select("word")).collect()} == {w: i for i, w in enumerate(order)}


def test_letters_joined(spark):
    words = "the a market salary make lowing will falls".split()
    w = segment.Words(words)
    assert w.split("themarketfalls") == ["the", "market", "falls"]
    assert w.join_letters("l o w i n g the salary w i l l m a k e x") == "lowing the salary will make x "
    assert segment.join_letters(spark.createDataFrame([("t h e cat",), (None,)], "text string"), words).collect()[0].text == "the cat"


# batches


class Client:
    def __call__(self, messages, stop):
        text = messages[-1]["content"]
        rows = json.loads(text[text.rindex("Statements:\n") + 12 : text.rindex("\nJSON =")])
        if len(rows) > 1 and any(r["statement"] == "bad" for r in rows):
            return "not json"
        return json.dumps([{"Question0": r["statement"].upper(), "Question1": 1, "id": r["id"]} for r in rows])


def test_classification(spark):
    df = spark.createDataFrame([(i, "bad" if i == 7 else f"s{i}") for i in range(20)], "id int, statement string")
    tasks = {"What?": ["a", "b"], "Why?": None}
    with pytest.raises(Exception, match="not a list"):
        classify.classify(df, tasks, Client, size=4).collect()
    got = {r.answer["id"]: r.answer["Question0"] for r in classify.classify(df, tasks, Client, size=4, one_by_one=True).collect()}
    assert got == {str(i): "BAD" if i == 7 else f"S{i}" for i in range(20)}
    skipped = classify.classify(df, tasks, Client, size=4, on_form="skip").collect()
    assert 15 < len([r for r in skipped if r.answer]) < 20 and {r.error for r in skipped} == {None, "form"}
    assert len(classify.classify(df, tasks, Client, result="raw").collect()) == 1
    assert classify.questions(["x", "y"]) == {"Question0": "x", "Question1": "y"}
    assert sum(r.n for r in classify.chunks(df, 3).collect()) == 20


class Failing:
    """Fails by service a few times, then by something else for one of the prompts."""

    def __init__(self):
        self.calls = 0

    def __call__(self, messages, stop):
        self.calls += 1
        if self.calls <= 2:
            raise classify.ServiceError("busy")
        if "s1" in messages[-1]["content"]:
            raise KeyError("no choices")
        return Client()(messages, stop)


def test_failures_of_the_client(spark):
    df = spark.createDataFrame([(1, "s1"), (2, "s2")], "id int, statement string").coalesce(1)
    run = lambda **o: classify.classify(df, {"What?": None, "Why?": None}, Failing, size=1, pause=0.01, workers=1, **o)
    rows = run(on_form="skip", on_number="ignore").collect()
    assert sorted((r.answer and r.answer["Question0"], r.error) for r in rows if r.answer) == [("S2", None)] and [r.error for r in rows if not r.answer] == ["form"]
    with pytest.raises(Exception, match="busy"):
        run(tries=2).collect()
    with pytest.raises(Exception, match="not a list"):
        run().collect()
    shout = lambda statements, *a: F.concat(F.lit("HEY\nStatements:\n"), F.upper(statements), F.lit("\nJSON ="))
    assert classify.classify(df, {"x": None}, lambda: lambda m, s: m[-1]["content"], size=1, result="raw", prompts=shout).first().reply.startswith("HEY")


def test_replies():
    assert classify.parse_reply('x ```json\n[{"a": "b\n"}]``` y', 1) == ([{"a": "b\n"}], False, False)
    assert classify.parse_reply('[{"a": 1}]', 2)[2] and classify.parse_reply("[1]", 1)[1] and classify.parse_reply("[{}]...", 1) == ([], True, True)


# sources and sinks


def test_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes("é one \n two\nthree".encode("latin-1"))
    rows = lines.read_lines(spark, str(tmp_path / "in"), 1, 3).collect()
    assert [(r.line_no, r.text) for r in rows] == [(1, "two"), (2, "three")]
    assert lines.read_lines(spark, str(tmp_path / "in"), 9).count() == 0
    assert lines.encodings(spark, str(tmp_path / "in")).first().encoding == "latin-1" and lines.guess_encoding(b"\xef\xbb\xbfa") == "utf-8-sig"
    df = spark.createDataFrame([("a\nb",), ("c",), (None,)], "text string").coalesce(1)
    assert lines.write_lines(df, str(tmp_path / "out"), compression="gzip") == 3
    assert gzip.decompress(next((tmp_path / "out").glob("*.gz")).read_bytes()) == b"a b\nc\n\n"
    assert lines.write_lines(df, str(tmp_path / "out"), mode="append") == 3 and lines.count_lines(spark, str(tmp_path / "out")) == 6
    assert lines.list_files(spark, str(tmp_path / "in")).count() == 1 and lines.list_folders(spark, str(tmp_path)).count() == 2
    sizes = [r.text for r in lines.blocks(df.na.fill(""), lambda x: [str(len(x))], 2).collect()]
    assert sizes == ["2", "1"]


def test_wide_dictionary(spark, tmp_path):
    dic = spark.createDataFrame([("a", "x", 0), ("a", "y, z", 1), ("b", "q", 0)], "dimension string, word string, rank int")
    dictionaries.write_wide(dic, str(tmp_path / "d"))
    assert sorted(map(tuple, dictionaries.read_wide(spark, str(tmp_path / "d")).collect())) == sorted(map(tuple, dic.collect()))
    (tmp_path / "s.csv").write_text("Word,Positive,Negative\nGOOD,2009,0\nBAD,0,1\n")
    assert {tuple(r) for r in dictionaries.read_sentiment(spark, str(tmp_path / "s.csv")).collect()} == {("positive", "good"), ("negative", "bad")}
    (tmp_path / "w.txt").write_text("risk  risks\nperil risk\n")
    assert {r.word for r in dictionaries.read_words(spark, str(tmp_path / "w.txt")).collect()} == {"risk", "risks", "peril"}


def test_html():
    page = "<html><head><title>no</title><script>x<1</script></head><body><nav>menu</nav><p>One<p>two &amp; <b>three</b><br>four<del>gone</del><ul><li>a<li>b</ul><!-- c --><table><tr><td>t</table></body>"
    assert documents.html_text(page) == "One two & three four a b"
    assert documents.html_text(page, None, whole=True) == "menu One two & three fourgone a b t"


def test_rtf_tei_and_pdf():
    assert documents.rtf_text(r"{\rtf1\ansi{\fonttbl{\f0 Times;}}{\*\gen x}Caf\'e9 " + "\\" + r"u8364?5\par next \{b\}}") == "Caf\u00e9 \u20ac5 next {b}"
    tei = '<TEI xmlns="http://x"><text><p>One <b>two</b></p><s>z</s><p>three</p></text></TEI>'
    assert documents.tei_texts(tei, ["text"], ["s", "p"]) == ["z", "Onetwo", "three"] and documents.tei_text(tei) == "Onetwozthree"
    page = lambda n, text: f"{n} 0 obj<</Length 9>>stream\nBT (Page) Tj [(on)-300(e \\051)]TJ ({text}) Tj ET\nendstream endobj ".encode()
    pdf = b"%PDF-1.4 1 0 obj<</Type/Pages/Kids[2 0 R 3 0 R]>>endobj 2 0 obj<</Type/Page/Parent 1 0 R/Contents 4 0 R>>endobj 3 0 obj<</Type/Page/Parent 1 0 R/Contents 5 0 R>>endobj " + page(4, "first") + page(5, "second")
    assert documents.pdf_pages(pdf) == 2 and documents.pdf_valid(pdf) and not documents.pdf_valid(b"x")
    assert documents.pdf_text(pdf, 1, 0).endswith("second") and "first" in documents.pdf_text(pdf, 0, 1) and "second" not in documents.pdf_text(pdf, 0, 1)


def test_read_documents(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>hi</p>")
    (tmp_path / "b.xyz").write_text("?")
    (tmp_path / "c.xml").write_text("<broken")
    (tmp_path / "d.up").write_bytes(b"q")
    got = {r.path.rsplit("/", 1)[1]: r for r in documents.read_documents(spark, str(tmp_path), {".up": lambda b: b.decode().upper()}).collect()}
    assert got["a.html"].text == "hi" and got["d.up"].text == "Q" and got["b.xyz"].text is None and got["c.xml"].error.startswith("ParseError")


def test_documents_keep_their_order(spark, tmp_path):
    (tmp_path / "b.html").write_text("<p>b</p>")
    (tmp_path / "a").write_text("{\\rtf1 a}")
    (tmp_path / "c.txt").write_text("c")
    names = [str(tmp_path / n) for n in ("b.html", "gone.html", "a", "c.txt", "b.html")]
    rows = documents.read_documents(spark, names, {"text/plain": lambda b: b.decode()}).orderBy("position").collect()
    assert [(r.position, r.kind, r.text) for r in rows] == [(0, "text/html", "b"), (1, None, None), (2, "application/rtf", "a"), (3, "text/plain", "c"), (4, "text/html", "b")]
    assert rows[1].error.startswith("FileNotFoundError") and all(r.error is None for i, r in enumerate(rows) if i != 1)
    assert [r.position for r in documents.read_documents(spark, str(tmp_path)).orderBy("path").collect()] == [0, 1, 2]


def test_saved_corpus_and_pairs(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b a"), (2, "b")], "key long, body string")
    corpus.save_corpus(df, f"{tmp_path}/c", "key", "body")
    own, frequencies = corpus.load_corpus(spark, f"{tmp_path}/c")
    assert {tuple(r) for r in own.collect()} == {(1, "a b a"), (2, "b")} and {tuple(r) for r in frequencies.collect()} == {("a", 1), ("b", 2)}
    (tmp_path / "p.csv").write_text("bigram,politicaltbb\nof_the,0.5\nto_me,2\n")
    assert {tuple(r) for r in dictionaries.read_weighted_pairs(spark, f"{tmp_path}/p.csv").collect()} == {("of the", 0.5), ("to me", 2.0)}


def test_tables_that_cut_lineage(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(1, "x", [1.5])], "a long, A_ string, c array<double>").toDF("a", "A", "c")
    own = checkpoints.Cut(df)
    assert own.df.columns == ["a", "A", "c"] and [tuple(r) for r in own.df.collect()] == [(1, "x", [1.5])]
    own.drop()
    assert checkpoints.small(df) and not checkpoints.small(df, 3)

    class Cluster:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            class _jsc:  # noqa: N801
                sc = staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))}))

        class conf:  # noqa: N801
            get = staticmethod(lambda k, d: d)

    with pytest.raises(ValueError, match="share"):
        checkpoints.shared_folder(Cluster)


def test_external_decoder(tmp_path):
    upper = documents.external(["sh", "-c", "tr a-z A-Z < {in} > {dir}/in.txt"], ".doc", str(tmp_path))
    assert upper(b"some  text") == "SOME TEXT" and not list(tmp_path.iterdir())
    assert documents.external(["cat", "{in}"], ".doc", str(tmp_path))(b"x\n y") == "x y"


def test_stream_resumes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("x y\nz\n")
    place = [str(tmp_path / p) for p in ("in", "out", "state")]
    run = lambda **o: stream.process_lines(spark, *place, lambda d: d.select("text", F.size(T.tokens("text")).alias("n")), **o)
    run()
    run()
    assert spark.read.parquet(place[1]).count() == 2
    (tmp_path / "in" / "b.txt").write_text("more\n")
    run()
    assert sorted(map(tuple, spark.read.parquet(place[1]).collect())) == [("more", 1), ("x y", 2), ("z", 1)]
    run(restart=True)
    assert spark.read.parquet(place[1]).count() == 3


def test_stream_of_tables(spark, tmp_path):
    place = [str(tmp_path / p) for p in ("in", "out", "state")]
    spark.createDataFrame([(1, "a b")], "doc_id long, text string").write.parquet(place[0])
    run = lambda: stream.process_table(spark, *place, lambda d: d.select("doc_id", F.size(T.tokens("text")).alias("n")))
    run()
    spark.createDataFrame([(2, "c")], "doc_id long, text string").write.mode("append").parquet(place[0])
    run()
    run()
    assert sorted(map(tuple, spark.read.parquet(place[1]).collect())) == [(1, 2), (2, 1)]


def test_limits():
    assert limits.call_within(20, lambda: 3) == 3
    began = time.time()
    with pytest.raises(TimeoutError):
        limits.call_within(0.2, time.sleep, 10)
    assert time.time() - began < 5
    with pytest.raises(ZeroDivisionError):
        limits.call_within(5, lambda: 1 / 0)
    said = []
    limits.timed(lambda n, s: said.append(n))(sorted)([1])
    assert said == ["sorted"]


def test_cosine_matrix_is_complete(spark):
    df = docs(spark, 6, 15)
    rows = tokens.similarity_matrix(df, df).collect()
    assert len(rows) == 36 and all(-1e-9 <= r.score <= 1 + 1e-9 for r in rows)
