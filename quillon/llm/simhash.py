"""Operator 10: SimHash fingerprints and all pairs within a Hamming radius.

Terms are pairs of neighbouring words, weighted by how often they occur; each adds its
weight to the bits that its 64-bit hash has set, and takes it from the others. The search
cuts the 64 bits into ``blocks`` blocks. At most ``radius`` of them can differ, so the pair
agrees on some ``blocks - radius`` of them: one table for each choice, keyed by those bits,
finds every pair. A pair is reported by the first of the tables that holds it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._frames import cut, pick, slices, split_words


def _word_hash(words: pa.Array) -> np.ndarray:
    coded = words.dictionary_encode()
    own = np.array([int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "big") for w in coded.dictionary.to_pylist()], np.uint64)
    return own[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.uint64)


def simhash(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint of each text, whether it has one: a text without words has none)."""
    offsets, words = split_words(texts, lower=True)
    h = _word_hash(words)
    n = offsets[1:] - offsets[:-1]
    with np.errstate(over="ignore"):
        term = np.zeros(len(h), np.uint64)
        term[:-1] = h[:-1] * np.uint64(31) + h[1:]
        last = offsets[1:][n > 0] - 1
        single = offsets[:-1][n == 1]
        term[single] = h[single]
    use = np.ones(len(h), bool)
    use[last] = False
    use[single] = True
    term = term[use]
    counts = np.where(n == 1, 1, np.maximum(n - 1, 0))
    some = counts > 0
    starts = (np.cumsum(counts) - counts)[some]
    out = np.zeros(len(n), np.uint64)
    if len(term):
        parts = []
        step = 1 << 16  # terms at a time: the bits of 65,536 are 4 MB
        ones = np.zeros((len(starts), 64), np.int64)
        owner = np.repeat(np.arange(len(starts)), counts[some])
        for a in range(0, len(term), step):
            bits = np.unpackbits(term[a : a + step].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            own = owner[a : a + step]
            cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            parts = np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
            ones[own[cuts]] += parts  # a document that the step cuts adds up over steps
        votes = 2 * ones > counts[some][:, None]
        out[some] = np.packbits(votes, axis=1).view(">u8").ravel().astype(np.uint64)
    return out, some


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint BIGINT``; rows whose text is null or has no words are left out.

    A bit whose votes are tied is 0. Texts of any length vote with all their words; a text of one word has
    that word as its only term. Repeated rows give repeated results, a null id stays null, extra columns
    are dropped, and an empty table gives an empty result.
    """
    narrow = pick(df, doc_id=id_col, text=text_col)
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            value, some = simhash(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").filter(pa.array(some)), pa.array(value[some].view(np.int64))], ["doc_id", "fingerprint"])

    return narrow.mapInArrow(run, f"doc_id {kind}, fingerprint long")


def masks(radius: int, blocks: int) -> list[int]:
    """The bits of each table's key, as signed 64-bit numbers."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    own = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    out = [sum(x) for x in combinations(own, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def near(prints: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """Pairs ``doc_a, doc_b, distance INT`` (``doc_a < doc_b``) of ``doc_id, fingerprint``.

    Documents of one fingerprint pair with the least of them only, at distance 0, and that one
    stands for all in the pairs of other fingerprints: two documents are within ``radius`` just
    if their least ones are. So groups of copies cost their size, not its square, and nothing
    is lost or capped. Rows with a null id or a null fingerprint pair with nothing. Rows that repeat an id and
    its fingerprint count once; an id with several fingerprints pairs by each of them, with itself never.
    An empty table gives an empty result.
    """
    if blocks <= radius:
        raise ValueError("blocks must exceed radius")
    prints = cut(prints.where(F.col("doc_id").isNotNull() & F.col("fingerprint").isNotNull()).select("doc_id", "fingerprint").distinct())
    least = cut(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("doc"), F.count("*").alias("n")))
    copies = prints.join(least.where("n > 1"), "fingerprint").where("doc_id <> doc").select(F.col("doc").alias("doc_a"), F.col("doc_id").alias("doc_b"), F.lit(0).alias("distance"))
    tables = F.array(*[F.lit(m) for m in masks(radius, blocks)])
    keyed = least.select("fingerprint", "doc", F.posexplode(F.transform(tables, lambda m: m.bitwiseAND(F.col("fingerprint")))).alias("table", "key"))
    a, b = (keyed.select("table", "key", F.col("fingerprint").alias("f" + s), F.col("doc").alias("doc_" + s)) for s in "ab")
    pairs = a.join(b, ["table", "key"]).where("doc_a < doc_b").withColumn("differ", F.col("fa").bitwiseXOR(F.col("fb"))).withColumn("distance", F.bit_count("differ"))
    first = F.array_position(F.transform(tables, lambda m: m.bitwiseAND(F.col("differ")) == 0), True) - 1
    pairs = pairs.where(F.col("distance") <= radius).where(first == F.col("table"))
    return pairs.select("doc_a", "doc_b", "distance").unionByName(copies)
