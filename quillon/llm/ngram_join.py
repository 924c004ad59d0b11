"""Operator 7: n-gram Jaccard self-join with Bayesian candidate pruning.

1. Each text becomes its set of hashed word n-grams, and 128 MinHash values of that set.
2. Documents of the very same set (Jaccard 1) are one node, whatever their number.
3. Nodes meet in buckets of 32 bands of 4 values. All buckets of one least node form one
   group, so a node travels once for each group, not once for each partner; a large group
   is spread over pairs of blocks. A pair of nodes counts in the first group that it shares.
4. In a group all pairs are compared, 16 MinHash values at a time. After n values with m
   equal ones, the posterior of the similarity under a uniform prior is Beta(m+1, n-m+1);
   a pair is dropped as soon as the probability of ``threshold`` or more is below
   ``tolerance``.
5. Only nodes with a pair that is left travel once more, with one text each, and the pairs
   are verified exactly on their sets. What leaves a block are counts and a spanning forest
   of its pairs, a row a node, never the pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._frames import BROADCAST_KEYS, Cut, cut, few, join_hot, mix64, pick, repeat_ranges, slices, split_words, word_hashes

VALUES, ROWS, RUNG = 128, 4, 16
#: Nodes of a block, and bytes of their texts, on average; a task compares two blocks at a time.
BLOCK, BLOCK_BYTES = 1024, 4 << 20
#: Edges that one task may join into groups; more are joined in distributed rounds.
FEW_EDGES = 1_000_000
_rng = np.random.default_rng(20)
_MULTIPLY = (_rng.integers(0, 1 << 31, VALUES, dtype=np.uint32) << 1) | 1
_ADD = _rng.integers(0, 1 << 32, VALUES, dtype=np.uint32)


def shingles(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashed n-grams of all texts in order, offsets). A text of fewer than ``n`` words is one n-gram; one without words has none."""
    offsets, words = split_words(texts)
    h = word_hashes(words)
    own = offsets[1:] - offsets[:-1]
    counts = np.where(own >= n, own - n + 1, (own > 0).astype(np.int64))
    if not len(h):
        return np.zeros(0, np.uint64), np.r_[0, np.cumsum(counts)]
    with np.errstate(over="ignore"):
        gram = np.zeros(len(h), np.uint64)
        length = np.repeat(own, own)
        left = length - (np.arange(len(h)) - np.repeat(offsets[:-1], own))  # words from here to the end of the text
        for k in range(n):
            here = h if not k else np.r_[h[k:], np.zeros(min(k, len(h)), np.uint64)][: len(h)]
            gram = np.where(left > k, mix64(gram + here + np.uint64(k + 1)), gram)
    first = np.arange(len(h)) == np.repeat(offsets[:-1], own)
    use = (left >= n) | (first & (length < n))
    return gram[use], np.r_[0, np.cumsum(counts)]


def minhash(gram: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """VALUES MinHash values of each text (uint32); of no meaning for one without n-grams."""
    some = offsets[1:] > offsets[:-1]
    out = np.zeros((len(some), VALUES), np.uint32)
    starts = offsets[:-1][some]
    if len(starts):
        base = (gram >> np.uint64(32)).astype(np.uint32)
        work = np.empty_like(base)
        for k in range(VALUES):
            np.multiply(base, _MULTIPLY[k], out=work)
            np.add(work, _ADD[k], out=work)
            out[some, k] = np.minimum.reduceat(work, starts)
    return out


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """``doc_id, k1, k2, size, digest BINARY, sig BINARY (a byte a value), bands ARRAY<BIGINT>`` of the rows that have words."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text")
            gram, offsets = shingles(texts, n)
            values = minhash(gram, offsets)
            keep = np.flatnonzero(offsets[1:] > offsets[:-1])
            bands = np.zeros((len(keep), VALUES // ROWS), np.uint64)
            with np.errstate(over="ignore"):
                for r in range(ROWS):
                    bands = mix64(bands * np.uint64(31) + values[keep][:, r::ROWS].astype(np.uint64))
                bands = mix64(bands + np.arange(VALUES // ROWS, dtype=np.uint64))  # a band's own buckets
            sig = mix64(values[keep].astype(np.uint64)).astype(np.uint8)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1, dtype=np.int32) * (VALUES // ROWS)), pa.array(bands.view(np.int64).ravel()))
            own = [batch.column(c).take(pa.array(keep)) for c in ("doc_id", "k1", "k2")]
            size = pc.binary_length(texts).take(pa.array(keep)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*own, size, pa.array(digests(gram, offsets, keep), pa.binary()), pa.array([s.tobytes() for s in sig], pa.binary()), lists], ["doc_id", "k1", "k2", "size", "digest", "sig", "bands"])

    return docs.mapInArrow(run, f"doc_id {kind}, k1 long, k2 long, size long, digest binary, sig binary, bands array<long>")


def digests(gram: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> list[bytes]:
    """16 bytes that stand for the set of each of these texts."""
    return [hashlib.blake2b(np.unique(gram[offsets[i] : offsets[i + 1]]).tobytes(), digest_size=16).digest() for i in which]


def fewest_matches(threshold: float, tolerance: float) -> list[int]:
    """After each rung, the fewest equal values with which a pair stays.

    P(J >= t) under Beta(m+1, n-m+1) is P(X <= m) for X binomial (n+1, t).
    """
    out = []
    for n in range(RUNG, VALUES + 1, RUNG):
        total = 0.0
        for m in range(n + 1):
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                out.append(m)
                break
    return out


def candidates(t: pa.Table, fewest: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(node, later nodes that stay after all rungs) of one pair of blocks; pairs that share an earlier group are left to it."""
    sigs = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint8).reshape(-1, VALUES)
    lo, hi = t["lo"][0].as_py(), t["hi"][0].as_py()
    part = t["own"].to_numpy() == hi
    lists = t["groups"].combine_chunks()
    width = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    own = np.repeat(np.arange(len(width)), width)
    places = np.arange(len(own)) - np.repeat(np.cumsum(width) - width, width)
    groups = np.full((len(width), int(width.max())), np.iinfo(np.int64).max)
    groups[own, places] = lists.flatten().to_numpy(zero_copy_only=False)
    here = t["g"][0].as_py()
    groups[groups >= here] = np.iinfo(np.int64).max
    earlier = (groups < here).any(1)
    n = len(part)
    for i in range(n):  # a row of the comparison at a time: memory stays linear
        if lo == hi:
            js = np.arange(i + 1, n)
        elif part[i]:
            continue
        else:
            js = np.flatnonzero(part)
        if earlier[i]:
            shared = np.zeros(len(js), bool)
            for x in groups[i][groups[i] < here]:
                shared |= (groups[js] == x).any(1)
            js = js[~shared]
        found = np.zeros(len(js), np.int64)
        for step, least in enumerate(fewest):
            if not len(js):
                break
            found = found + (sigs[js, step * RUNG : (step + 1) * RUNG] == sigs[i, step * RUNG : (step + 1) * RUNG]).sum(1)
            js, found = js[found >= least], found[found >= least]
        if len(js):
            yield i, js


def verified(t: pa.Table, n: int, threshold: float, fewest: list[int], forest: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(node, weight of its links, greatest similarity, another node of its group) of the nodes of one pair of blocks that have a link.

    ``forest`` skips pairs whose nodes are in one group already, so the weights and similarities are of no meaning.
    """
    gram, offsets = shingles(t["text"].combine_chunks(), n)
    owner = np.repeat(np.arange(t.num_rows), offsets[1:] - offsets[:-1])
    order = np.lexsort((gram, owner))
    gram, owner = gram[order], owner[order]
    fresh = np.r_[True, (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])]
    gram, owner = gram[fresh], owner[fresh]
    code = np.unique(gram, return_inverse=True)[1].ravel()
    ends = np.searchsorted(owner, np.arange(t.num_rows + 1))
    sizes = ends[1:] - ends[:-1]
    weight = t["docs"].to_numpy()
    label = np.arange(t.num_rows)
    links, best = np.zeros(t.num_rows, np.int64), np.zeros(t.num_rows)
    mark = np.zeros(code.max() + 1, bool)
    for i, js in candidates(t, fewest):
        if forest:
            js = js[label[js] != label[i]]
        if not len(js):
            continue
        own = code[ends[i] : ends[i + 1]]
        mark[own] = True
        both = np.add.reduceat(mark[code[repeat_ranges(ends[js], sizes[js])]], np.cumsum(sizes[js]) - sizes[js], dtype=np.int64)
        mark[own] = False
        jaccard = both / (sizes[i] + sizes[js] - both)
        js, jaccard = js[jaccard >= threshold], jaccard[jaccard >= threshold]
        if not len(js):
            continue
        links[i] += weight[js].sum()
        links[js] += weight[i]
        best[i] = max(best[i], jaccard.max())
        best[js] = np.maximum(best[js], jaccard)
        joined = np.unique(label[np.r_[i, js]])
        label[np.isin(label, joined)] = joined[0]
    some = np.flatnonzero(links)
    return some, links[some], best[some], label[some]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each pair of blocks, from batches in their order."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("g", "lo", "hi"))))
        a = 0
        for b in range(1, len(keys) + 1):
            if b < len(keys) and keys[b] == keys[a]:
                continue
            if held and keys[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = keys[a]
            a = b
    if held:
        yield pa.Table.from_batches(held)


def _in_blocks(df: DataFrame) -> DataFrame:
    return df.repartition("g", "lo", "hi").sortWithinPartitions("g", "lo", "hi")


def _meetings(nodes: DataFrame) -> DataFrame:
    """``g, lo, hi, own, digest, groups``: every node once for each pair of blocks, of each of its groups, that it is in.

    A group's number is the least hash of a node in one of its buckets; that groups could share one does no harm.
    """
    buckets = nodes.select("digest", F.explode("bands").alias("band"))
    least = cut(buckets.groupBy("band").agg(F.min(F.xxhash64("digest")).alias("g"), F.count("*").alias("n")).where("n > 1"))
    member = cut(join_hot(buckets, least, "band", "n").select("digest", "g").distinct().join(nodes.select("digest", "size"), "digest"))
    sized = member.groupBy("g").agg(F.count("*").alias("n"), F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_BYTES)).cast("int").alias("blocks"))
    member = join_hot(member, sized.where("n > 1"), "g", "n").withColumn("own", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    # a node has at most a group a band
    mine = member.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("g", "own", "blocks"))).alias("m"))
    each = mine.select("digest", F.transform("m", lambda m: m["g"]).alias("groups"), F.explode("m").alias("m")).select("digest", "groups", "m.*")
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return each.select("g", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "digest", "groups")


class Classes:
    """Documents by their sets of n-grams, and what links the sets."""

    def __init__(self, docs: DataFrame, n: int, threshold: float, tolerance: float, forest: bool):
        """``docs``: doc_id, text. ``forest`` finds the classes only, with fewer comparisons."""
        docs = docs.where(F.col("text").isNotNull()).withColumns(row_keys("doc_id", "text"))
        sets = cut(signatures(docs, n))
        #: digest, doc_id, k1, k2, number of rows
        self.rows = cut(sets.groupBy("digest", "doc_id", "k1", "k2").agg(F.count("*").alias("rows")))
        first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", F.struct("k1", "k2").alias("key"))).alias("least")
        keys = self.rows.groupBy("digest").agg(first, F.count("*").alias("keys"))
        weights = self.rows.groupBy("digest", "doc_id").agg(F.lit(1)).groupBy("digest").agg(F.count("*").alias("docs"))
        shape = sets.groupBy("digest").agg(F.max("size").alias("size"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
        #: digest, least document, number of texts and of documents, signature
        self.nodes = cut(shape.join(keys, "digest").join(weights, "digest"))
        fewest = fewest_matches(threshold, tolerance)

        def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in _runs(batches):
                if t.num_rows > 1:
                    some = np.zeros(t.num_rows, bool)
                    for i, js in candidates(t, fewest):
                        some[i] = some[js] = True
                    yield from t.filter(pa.array(some)).to_batches()

        meetings = _meetings(self.nodes).join(self.nodes.select("digest", "sig", "docs", "least.key"), "digest")
        left = cut(_in_blocks(meetings).mapInArrow(prune, meetings.schema))
        wanted = left.select("key.k1", "key.k2").distinct()
        texts = docs.select("k1", "k2", "text").join(few(wanted), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
        carried = left.withColumns({"k1": F.col("key.k1"), "k2": F.col("key.k2")}).drop("key").join(texts, ["k1", "k2"])

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in _runs(batches):
                if t.num_rows > 1:
                    some, links, best, root = verified(t, n, threshold, fewest, forest)
                    own = t["digest"].combine_chunks()
                    yield pa.RecordBatch.from_arrays([own.take(pa.array(some)), pa.array(links), pa.array(best), own.take(pa.array(root))], ["digest", "links", "jaccard", "root"])

        #: digest, links, jaccard, another digest of the group: a row for each pair of blocks in which a node has links
        self.found = cut(_in_blocks(carried).mapInArrow(verify, "digest binary, links long, jaccard double, root binary"))
        self.roots = groups(self.found.where("digest <> root").select(F.col("root").alias("doc_a"), F.col("digest").alias("doc_b"))).select(F.col("doc_id").alias("digest"), "leader")

    def leaders(self) -> DataFrame:
        """``digest, docs, keys, leader``: the least document of the class of each node."""
        own = self.nodes.select("digest", "docs", "keys", "least")
        several = own.join(self.roots.withColumnRenamed("leader", "root"), "digest")
        least = several.groupBy("root").agg(F.min("least").alias("leader"), F.count("*").alias("n"))
        single = own.join(self.roots, "digest", "left_anti").withColumnRenamed("least", "leader")
        return cut(join_hot(several, least, "root", "n").select(*single.columns).unionByName(single))


def row_keys(doc_id: str, text: str) -> dict:
    """128 bits, as two numbers, that tell a row by its id and its text."""
    return {"k1": F.xxhash64(doc_id, text), "k2": F.xxhash64(text, F.lit("row"), doc_id)}


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, threshold: float = 0.5, tolerance: float = 0.001) -> DataFrame:
    """``doc_id, class_id, links BIGINT, jaccard DOUBLE``: a row for each document that has another one of Jaccard ``threshold`` or more.

    ``links`` is the number of such documents, ``jaccard`` the greatest similarity to one of them;
    ``class_id`` is the least ``doc_id`` of all documents that links connect. Documents that
    aren't in the result have no link and are a class of their own. Words lie between white space.

    Found links are exact; a pair at the threshold itself is found with probability 0.87, one
    at 0.6 with 0.99; documents of one n-gram set are always found. Null, empty and blank texts
    link with nothing. Rows of one id and one n-gram set are one document; rows of one id with
    other n-grams are further documents, with rows of their own in the result. A null id is an id,
    the greatest: it is a class's id only where the class has no other. Extra columns are dropped;
    an empty table gives an empty result.
    """
    own = Classes(pick(df, doc_id=id_col, text=text_col), n, threshold, tolerance, forest=False)
    near = own.found.groupBy("digest").agg(F.sum("links").alias("near"), F.max("jaccard").alias("jaccard"))
    of_node = own.leaders().join(near, "digest", "left").where((F.col("docs") > 1) | F.col("near").isNotNull())
    rows = join_hot(own.rows.select("digest", "doc_id").distinct(), of_node, "digest", "docs")
    return rows.select("doc_id", F.col("leader.doc_id").alias("class_id"), (F.col("docs") - 1 + F.coalesce("near", F.lit(0))).alias("links"), F.when(F.col("docs") > 1, 1.0).otherwise(F.round("jaccard", 6)).alias("jaccard"))


def _union(edges: DataFrame, kind: str) -> DataFrame:
    """``doc_id, leader`` of a few edges, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def top(x):
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
        ids = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array([top(x) for x in ids], id_type)], ["doc_id", "leader"])

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(edges.schema["doc_a"].dataType)
    return edges.coalesce(1).mapInArrow(run, f"doc_id {kind}, leader {kind}")


def groups(pairs: DataFrame) -> DataFrame:
    """``doc_id, leader``: the least document of each connected group of pairs ``doc_a, doc_b``, for those that have another one.

    Up to ``FEW_EDGES`` edges one task joins them. Of more, labels fall to the least neighbour and jump to
    their label's label, in rounds until none changes; the number of rounds grows with the
    logarithm of a group's diameter. A pair of a document with itself, or with a null, is no edge.
    """
    own = pairs.select("doc_a", "doc_b").where("doc_a <> doc_b")
    pairs = own.select(F.least("doc_a", "doc_b").alias("doc_a"), F.greatest("doc_a", "doc_b").alias("doc_b")).distinct()
    if pairs.limit(FEW_EDGES + 1).count() <= FEW_EDGES:
        return cut(_union(pairs, pairs.schema["doc_a"].dataType.simpleString()))
    pairs = cut(pairs)
    both = pairs.select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"))
    edges = cut(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    label = Cut(edges.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("leader"), F.count("*").alias("n")))
    while True:
        lower = join_hot(edges.withColumnRenamed("a", "_x"), label.df.select(F.col("a").alias("b"), "leader", "n"), "b", "n").groupBy(F.col("_x").alias("a")).agg(F.min("leader").alias("seen"))
        low = label.df.join(lower, "a").select("a", "n", F.least("leader", "seen").alias("leader"), F.col("leader").alias("old"))
        low = Cut(low)
        asked = low.df.groupBy("leader").agg(F.count("*").alias("asked"))
        jump = asked.join(label.df.select(F.col("a").alias("leader"), F.col("leader").alias("root")), "leader", "left")
        new = Cut(join_hot(low.df, cut(jump), "leader", "asked").select("a", "n", F.least("leader", F.coalesce("root", "leader")).alias("leader"), "old"))
        moved = new.df.where("leader <> old").limit(1).count()
        label.drop()
        low.drop()
        label = new
        if not moved:
            return label.df.select(F.col("a").alias("doc_id"), "leader")


def drop_duplicates(documents: DataFrame, n: int = 3, threshold: float = 0.5, tolerance: float = 0.001) -> DataFrame:
    """One document of each class, the one of least ``doc_id`` (a null is the greatest); all columns.

    Classes are those of ``join``, null ids included. Of rows of one id and one n-gram set the one
    of least text by hash stays, of rows that are alike in id and text any one. Null, empty and
    blank texts stay as they are, and an empty table stays empty.
    """
    own = Classes(pick(documents, doc_id="doc_id", text="text"), n, threshold, tolerance, forest=True)
    judged = join_hot(own.rows, own.leaders(), "digest", "keys").withColumn("gone", (F.col("k1") != F.col("leader.key.k1")) | (F.col("k2") != F.col("leader.key.k2")))
    told = cut(judged.where(F.col("gone") | (F.col("rows") > 1)).select("k1", "k2", "gone", "rows"))
    names = [f"_c{i}" for i in range(len(documents.columns))]
    flat = documents.toDF(*names).withColumns(row_keys(*(names[documents.columns.index(c)] for c in ("doc_id", "text"))))
    flat = flat.join(F.broadcast(told), ["k1", "k2"], "left") if told.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else join_hot(flat, told, ["k1", "k2"], "rows", "left")
    kept = flat.where("gone is null").select(*names)
    if told.where("not gone").limit(1).count():  # rows that occur several times, of which one stays
        kept = kept.unionByName(flat.where("not gone").dropDuplicates(["k1", "k2"]).select(*names))
    return kept.toDF(*documents.columns)
