"""Sharding, chat logs, the pipeline and the entry points."""

from __future__ import annotations

import hashlib
import math
import random
import subprocess
import sys
from bisect import bisect_left
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import chat, decontam, ngram_join, pii, quality, queries, ring
from quillon.llm._frames import pick
from tests.llm.conftest import DATA, prose

ROOT = Path(__file__).parents[2]


def slow_assign(keys, shards, virtual_nodes, slack):
    """How many rows of each key are at each (shard, hops), a key after another."""
    points = sorted((int(hashlib.md5(f"shard-{s}-{v}".encode()).hexdigest(), 16) >> 96, s) for s in range(shards) for v in range(virtual_nodes))
    capacity = math.ceil((1 + slack) * len(keys) / shards)
    digest = {k: hashlib.md5(str("null" if k is None else k).encode()).hexdigest() for k in keys}
    place = {k: int(d[:8], 16) for k, d in digest.items()}
    rank = {k: (int(d[8:23], 16), k is not None, k) for k, d in digest.items()}
    load, out, waiting, hops = Counter(), Counter(), list(keys), 0
    while waiting:
        full = {s for s in range(shards) if load[s] == capacity}
        asked = defaultdict(list)
        for k in waiting:
            later = [s for x, s in points if x >= place[k] and s not in full] + [s for _, s in points if s not in full]
            asked[later[0]].append(k)
        waiting = []
        for s, ks in asked.items():
            ks.sort(key=rank.get)
            room = capacity - load[s]
            out.update((k, s, hops) for k in ks[:room])
            load[s] += len(ks[:room])
            waiting += ks[room:]
        hops += 1
    return out


@pytest.mark.parametrize("shards,nodes,slack", [(8, 16, 0.1), (5, 4, 0.0), (1, 1, 0.5), (12, 3, 0.25)])
def test_ring_against_simulation(spark, shards, nodes, slack):
    keys = [*range(700), *[9] * 300, *[None] * 20]  # one key has a third of all rows
    df = spark.createDataFrame([(k,) for k in keys], "doc_id long")
    got = Counter(tuple(r) for r in ring.assign(df, shards=shards, virtual_nodes=nodes, slack=slack).collect())
    assert got == slow_assign(keys, shards, nodes, slack)
    assert max(Counter(s for _, s, _ in got.elements()).values()) <= math.ceil((1 + slack) * len(keys) / shards)


@pytest.mark.parametrize("most", [10**7, 0])
def test_ring_of_many_shards(spark, most, monkeypatch):
    """2,000 shards of 128 points, by broadcast and by shuffle."""
    monkeypatch.setattr(ring, "BROADCAST_POINTS", most)
    got = ring.assign(spark.range(4000).withColumnRenamed("id", "doc_id"), shards=2000, slack=5.0).collect()
    points = ring.ring_points(2000, 128)
    places = [x for x, _ in points]
    for r in got[::40]:
        at = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:8], 16)
        assert r.hops or r.shard == points[bisect_left(places, at) % len(points)][1]
    assert len(got) == 4000 and max(Counter(r.shard for r in got).values()) <= 12


def test_few_keys_move(spark):
    df = spark.range(3000).withColumnRenamed("id", "doc_id")
    a, b = ({r.doc_id: r.shard for r in ring.assign(df, shards=s, virtual_nodes=64).collect()} for s in (10, 11))
    assert sum(a[k] != b[k] for k in a) < 0.35 * len(a)


def test_ring_awkward(awkward, empty):
    rows = ring.assign(awkward, shards=4, virtual_nodes=8).collect()
    assert len(rows) == awkward.count() and max(Counter(r.shard for r in rows).values()) <= math.ceil(1.1 * len(rows) / 4)
    assert ring.assign(empty).count() == 0


# chat


def slow_fold(events):
    """Apply events one after another."""
    state: dict = {}
    for conv, seq, kind, turn, role, text in sorted({e for e in events if None not in (e[0], e[1], e[3])}, key=lambda e: (e[1], e[5] or "")):
        kind, text = kind or "message", text or ""
        mine = state.setdefault(conv, {})
        if kind not in (*chat.RESETS, "delta"):
            continue
        if kind == "regenerate":
            for t in [t for t in mine if t > turn]:
                del mine[t]
        old_role, old = mine.get(turn, (None, ""))
        mine[turn] = (role or old_role, old + text if kind == "delta" else text)
    return {(c, t, r, x) for c, m in state.items() for t, (r, x) in m.items()}


def test_fold_against_events_in_order(spark):
    rng = random.Random(8)
    events = []
    for conv in range(60):
        for seq in range(rng.randrange(1, 30)):
            events.append((conv, seq, rng.choice(["message", "delta", "delta", "delta", "edit", "regenerate", None, "ping"]), rng.randrange(4), rng.choice(["user", "assistant", None]), rng.choice(["a", "b ", "", None, "long piece"])))
    events += events[::5]
    rng.shuffle(events)
    schema = "conv_id long, seq long, kind string, turn long, role string, text string"
    got = {tuple(r) for r in chat.fold(spark.createDataFrame(events, schema)).collect()}
    assert got == slow_fold(events)


def test_render(spark):
    df = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, None, None), (None, 0, "user", "x"), (3, None, "user", "x")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.n_messages, r.rendered) for r in chat.format_conversations(df).collect()}
    assert got == {1: (2, "<|user|>\na<|end|>\n<|assistant|>\nb<|end|>\n"), 2: (1, "<|unknown|>\n<|end|>\n")}
    clash = df.withColumn("Turn_", F.lit(1)).toDF("conv_id", "turn", "role", "text", "TEXT")
    assert {r.conv_id: (r.n_messages, r.rendered) for r in chat.format_conversations(clash).collect()} == got
    assert chat.format_conversations(df.limit(0)).count() == 0


# pipeline


def test_stages_against_brute_force(spark, tables):
    """Each stage is held against what its decisions mean, on its own input."""
    sf = str(DATA)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "personal_data", "encoding"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
        seen[name] = {r.doc_id: r for r in docs.collect()}
        if name != "encoding":
            assert docs.columns == columns and docs.dtypes == before.dtypes
    original = {r.doc_id: r for r in before.collect()}
    model = quality.train(before, spark.read.parquet(f"{sf}/labels.parquet"))
    assert set(seen["quality"]) == {r.doc_id for r in quality.score(before, model).where("keep").collect()}
    from tests.llm.test_search import brute_classes

    leader = brute_classes([(d, r.text) for d, r in seen["quality"].items()], 0.5)[1]
    want = {x[0] for x, y in leader.items() if x == y}
    assert len(want ^ set(seen["near_duplicates"])) <= 2
    held = {r.doc_id for r in decontam.find(before, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert set(seen["decontamination"]) == set(seen["near_duplicates"]) - held
    texts = [(d, original[d].text) for d in sorted(seen["decontamination"])]
    p = pii.train()
    for (d, text), found in zip(texts, pii.entities([t for _, t in texts], p)):
        assert seen["personal_data"][d].text == pii.redact(text, found)
    assert set(seen["encoding"]) == set(seen["personal_data"]) and all(r.round_trip for r in seen["encoding"].values())
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == set(seen["encoding"])


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_awkward(spark, tmp_path, awkward, empty, stage):
    spark.createDataFrame([(None, 1, 1), (2, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(80, 77)), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    own, words = Counter(repr(r[:2]) for r in awkward.collect()), [r for r in awkward.collect() if r.text and r.text.strip()]
    out = stage(spark, awkward, str(tmp_path))
    if stage is corpus_pipeline.STAGES[-1][1]:
        assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in awkward.collect())
    else:
        assert out.columns == awkward.columns
        want = {"_quality": Counter(repr(r[:2]) for r in words), "_decontaminate": own, "_mask": own}.get(stage.__name__)
        got = Counter(repr(r[:2]) for r in out.collect())
        assert got == want if want else not got - own and sum(got.values()) == sum(own.values()) - 3
    assert stage(spark, empty, str(tmp_path)).count() == 0


def test_run_awkward(spark, tmp_path, awkward, empty):
    """All stages in a row: what is kept of an awkward table is what the stages' rules keep, and nothing of an empty one."""
    for name, docs in (("full", awkward), ("none", empty)):
        pick(docs, doc_id="doc_id", text="text").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(None, 1, 1), (2, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        spark.createDataFrame([(1, prose(80, 77)), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, f"{tmp_path}/full").collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(map(str, [1, 5, 6, 7, 9, 10, None])) and all(r.round_trip and r.n_tokens for r in rows)
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []


def test_queries_and_sql(spark):
    import __spark_entry__

    numbers = [n.split("_")[0] for n in queries.queries()]
    assert numbers == [f"op{i}" for i in range(1, 11)] and "pipeline" in __spark_entry__.queries()
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_chat_query_against_sql(spark, tables):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{DATA}/conversations.parquet'")
    want = {tuple(r) for r in con.execute(queries.oracle_sql()["op9_chat_format"]).fetchall()}
    assert {tuple(r) for r in queries.op9_chat_format(spark, str(DATA)).collect()} == want


def test_rest_imports_without_these_folders(tmp_path):
    code = "import shutil, sys; sys.path.insert(0, '.'); import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; e.oracle_sql()"
    import shutil

    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={"PATH": "/usr/bin:/bin"}, timeout=120)
