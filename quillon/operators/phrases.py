"""Phrases of two words: counted in and applied to whole batches of words."""

from __future__ import annotations

from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.functions.words import gram_counts, split_words

#: Bytes of phrases that one pass over the texts broadcasts; a larger model makes more passes.
PASS_BYTES = 64 << 20
_GLUE = "\x1f"


def fit(df: DataFrame, threshold: float, min_count: int = 10, connectors: Collection[str] = (), text_col: str = "text", scoring: str = "default") -> DataFrame:
    """``first, second, n, score`` of pairs of neighbouring words that pass ``threshold``.

    Connector words may stand between the two; they belong to ``middle``, an array. Scores: default is
    (n_ab - min_count) * V / (n_a * n_b) with V distinct words; ``npmi`` is ln(p_ab / p_a p_b) / -ln p_ab.
    """
    if scoring not in ("default", "npmi"):
        raise ValueError("scoring: default or npmi")
    toks = df.select(T.tokens(text_col).alias("t"))
    words = gram_counts(toks, "t", 1).groupBy(F.get("ngram", F.lit(0)).alias("w")).agg(F.sum("n").alias("n"))
    own = sorted(set(connectors))
    if own:
        isc = lambda w: w.isin(*own)
        # the place of the next word that is no connector, for each word that is none
        indexed = toks.select("t", F.filter(F.transform("t", lambda w, i: F.when(~isc(w), i)), lambda i: i.isNotNull()).alias("at"))
        pairs = indexed.select("t", F.explode(F.zip_with(F.slice("at", 1, F.greatest(F.size("at") - 1, F.lit(0))), F.slice("at", 2, F.greatest(F.size("at") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("p"))
        pairs = pairs.select(F.get("t", F.col("p.a")).alias("first"), F.slice("t", F.col("p.a") + 2, F.col("p.b") - F.col("p.a") - 1).alias("middle"), F.get("t", F.col("p.b")).alias("second"))
        counted = pairs.groupBy("first", "middle", "second").agg(F.count("*").alias("n"))
    else:
        counted = gram_counts(toks, "t", 2).groupBy(F.get("ngram", F.lit(0)).alias("first"), F.get("ngram", F.lit(1)).alias("second")).agg(F.sum("n").alias("n"))
        counted = counted.select("first", F.array().cast("array<string>").alias("middle"), "second", "n")
    counted = counted.where(F.col("n") >= min_count)
    total = words.agg(F.count("*").alias("v"), F.sum("n").alias("total"))
    a, b = (words.select(F.col("w").alias(x), F.col("n").alias("n_" + x)) for x in ("first", "second"))
    scored = counted.join(a, "first").join(b, "second").crossJoin(F.broadcast(total))  # total: one row
    if scoring == "default":
        score = (F.col("n") - min_count) * F.col("v") / (F.col("n_first") * F.col("n_second").cast("double"))
    else:
        p = F.col("n") / F.col("total")
        score = F.log(p * F.col("total") * F.col("total") / (F.col("n_first") * F.col("n_second").cast("double"))) / -F.log(p)
    return scored.select("first", "middle", "second", "n", score.alias("score")).where(F.col("score") > threshold)


def apply(df: DataFrame, phrases: DataFrame, connectors: Collection[str] = (), sep: str = "_", text_col: str = "text") -> DataFrame:
    """The frame with phrases of its text joined by ``sep``, greedily from the left; words are rejoined by spaces. Null stays null.

    Words lie between ASCII white space, as where phrases are counted.
    """
    place = df.columns.index(text_col)
    names = df.columns
    flat = df.toDF(*[f"_c{i}" for i in range(len(names))])
    rows = flat.withColumn("_hits", F.array().cast("array<int>"))
    schema = rows.schema
    between = pa.array(sorted(set(connectors)), pa.string())
    parts = _passes(phrases)
    part = next(parts)
    while part is not None:
        shared, part = df.sparkSession.sparkContext.broadcast(part), next(parts, None)
        last = part is None

        def run(batches: Iterator[pa.RecordBatch], shared=shared, last=last) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = batch.columns
                offsets, words = split_words(columns[place])
                hits = known_pairs(offsets, words, shared.value, between, columns[-1])
                if last:
                    columns[place] = pc.if_else(columns[place].is_valid(), joined(offsets, words, hits, between, sep), pa.scalar(None, pa.string()))
                columns[-1] = _as_lists(offsets, hits)
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

        rows = rows.mapInArrow(run, schema)
    return rows.drop("_hits").toDF(*names)


def _passes(phrases: DataFrame) -> Iterator[pa.Array]:
    """The phrases in arrays of up to PASS_BYTES, one at least; the driver holds two at a time."""
    own, size, some = [], 0, False
    for r in phrases.select(F.array_join(F.concat(F.array("first"), "middle", F.array("second")), _GLUE)).toLocalIterator():
        own.append(r[0])
        size += len(r[0].encode())
        if size > PASS_BYTES:
            yield pa.array(own, pa.string())
            own, size, some = [], 0, True
    if own or not some:
        yield pa.array(own, pa.string())


def known_pairs(offsets: np.ndarray, words: pa.Array, known: pa.Array, between: pa.Array, before: pa.Array | None = None) -> np.ndarray:
    """Where phrases begin, overlapping ones too: places among all words. ``before`` has those of earlier passes, by text."""
    out = np.zeros(0, np.int64)
    if before is not None and len(flat := before.flatten()):
        count = pc.list_value_length(before).to_numpy(zero_copy_only=False).astype(np.int64)
        out = np.repeat(offsets[:-1], count) + flat.to_numpy(zero_copy_only=False)
    if len(words) < 2:
        return out
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    plain = ~pc.is_in(words, between).to_numpy(zero_copy_only=False) if len(between) else np.ones(len(words), bool)
    at = np.flatnonzero(plain)  # a phrase begins and ends with words that are no connectors
    a, b = at[:-1], at[1:]
    same = text[a] == text[b]
    a, b = a[same], b[same]
    if not len(a):
        return out
    size = b - a + 1
    ends = np.cumsum(size)
    every = np.repeat(a - (ends - size), size) + np.arange(ends[-1])
    keys = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), words.take(pa.array(every))), _GLUE)
    return np.r_[out, a[pc.is_in(keys, known).to_numpy(zero_copy_only=False)]]


def joined(offsets: np.ndarray, words: pa.Array, hits: np.ndarray, between: pa.Array, sep: str) -> pa.Array:
    """The texts with phrases that begin at ``hits`` joined, of a run of overlapping ones every second."""
    n = len(words)
    plain = ~pc.is_in(words, between).to_numpy(zero_copy_only=False) if len(between) else np.ones(n, bool)
    number = np.cumsum(plain) - 1  # of the words that are no connectors
    hit = np.zeros(int(plain.sum()) + 1, bool)
    hit[number[hits]] = True
    place = np.arange(len(hit))
    start = hit & ~np.r_[False, hit[:-1]]
    chosen = np.flatnonzero(hit & ((place - np.maximum.accumulate(np.where(start, place, 0))) % 2 == 0))
    at = np.r_[np.flatnonzero(plain), n]
    inside = np.zeros(n + 1, np.int64)  # from a phrase's first word up to its last
    np.add.at(inside, at[chosen], 1)
    np.add.at(inside, at[chosen + 1], -1)
    glue = np.where(np.cumsum(inside)[:n] > 0, sep, " ").astype(object)
    glue[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = ""
    pieces = pc.binary_join_element_wise(words, pa.array(glue, pa.string()), "")
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pieces), "")


def _as_lists(offsets: np.ndarray, hits: np.ndarray) -> pa.Array:
    """The places of hits in their texts, a list a text."""
    hits = np.sort(hits)
    text = np.searchsorted(offsets, hits, side="right") - 1
    ends = np.searchsorted(text, np.arange(len(offsets)))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array((hits - offsets[text]).astype(np.int32) if len(hits) else np.zeros(0, np.int32)))
