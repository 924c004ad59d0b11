"""Sentence centrality by the stationary distribution of a similarity graph, a document at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def markov(similarity: np.ndarray) -> np.ndarray:
    """Rows that sum to 1: divided by their sums, or by softmax if any value isn't positive."""
    if similarity.min() <= 0:
        e = np.exp(similarity - similarity.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)
    return similarity / similarity.sum(1, keepdims=True)


def components(matrix: np.ndarray) -> list[np.ndarray]:
    """Nodes that links in either direction join, by least node."""
    n = len(matrix)
    label = np.arange(n)
    links = (matrix > 0) | (matrix > 0).T
    while True:
        low = np.minimum(label, np.where(links, label[None, :], n).min(1))
        if (low == label).all():
            break
        label = low
    return [np.flatnonzero(label == x) for x in np.unique(label)]


def stationary(matrix: np.ndarray, squared: bool = True, rounds: int = 10_000) -> np.ndarray:
    """Power iteration from ones; ``squared`` doubles the steps of each round."""
    v, step = np.ones(len(matrix)), matrix
    for _ in range(rounds):
        new = v @ step
        if np.allclose(new, v):
            return new
        v = new
        if squared:
            step = step @ step
    return v


def centrality(similarity: np.ndarray, threshold: float | None = None, squared: bool = True) -> np.ndarray:
    """The score of each sentence; those of a component sum to its size. ``threshold`` makes links of 1 or 0 first."""
    if threshold is not None and not 0 <= threshold < 1:
        raise ValueError("threshold must be in [0, 1)")
    if not len(similarity):
        return np.zeros(0)
    m = markov(np.asarray(similarity, float) if threshold is None else (np.asarray(similarity) >= threshold).astype(float))
    out = np.zeros(len(m))
    for nodes in components(m):
        out[nodes] = stationary(m[np.ix_(nodes, nodes)], squared)
    return out


_WORD = re.compile(r"[^ \t\n\x0b\f\r]+")
#: Similarities that are held at a time, by rows of sentences.
BLOCK = 1 << 22


def sentence_weights(sentences: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sentence, word, weight) of the sentences' words: counts times ln(1 + n / df) within the document, of unit length a sentence."""
    bags = [_WORD.findall(s.lower()) for s in sentences]
    row = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    code: dict[str, int] = {}
    word = np.array([code.setdefault(w, len(code)) for b in bags for w in b], np.int64)
    key, count = np.unique(row * max(len(code), 1) + word, return_counts=True)
    row, word = key // max(len(code), 1), key % max(len(code), 1)
    value = count * np.log(1 + len(bags) / np.maximum(np.bincount(word, minlength=max(len(code), 1)), 1))[word]
    norm = np.sqrt(np.bincount(row, value * value, len(bags)))
    return row, word, value / norm[row]


def similarity_rows(row: np.ndarray, word: np.ndarray, value: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first sentence, its and the next ones' similarities to all) in blocks."""
    words = int(word.max()) + 1 if len(word) else 0
    if n and n * max(n, words) <= BLOCK:
        x = np.zeros((n, words))
        x[row, word] = value
        yield 0, x @ x.T
        return
    order = np.lexsort((row, word))
    by_word, by_row, by_value = word[order], row[order], value[order]
    begin = np.searchsorted(by_word, np.arange(by_word[-1] + 2 if len(by_word) else 1))
    step = max(1, BLOCK // max(n, 1))
    for a in range(0, n, step):
        out = np.zeros((min(step, n - a), n))
        for w in np.unique(word[(row >= a) & (row < a + step)]).tolist():
            rows, x = by_row[begin[w] : begin[w + 1]], by_value[begin[w] : begin[w + 1]]
            i, j = np.searchsorted(rows, (a, a + step))
            out[np.ix_(rows[i:j] - a, rows)] += np.outer(x[i:j], x)
        yield a, out


def sentence_similarity(sentences: list[str]) -> np.ndarray:
    """Cosine of the sentences' words, weighted as in ``sentence_weights``."""
    parts = [x for _, x in similarity_rows(*sentence_weights(sentences), len(sentences))]
    return np.concatenate(parts) if parts else np.zeros((0, 0))


def sentence_centrality(sentences: list[str], threshold: float | None = None) -> np.ndarray:
    """``centrality(sentence_similarity(sentences), threshold)`` without its matrix.

    The matrix is symmetric, as are its exponentials, so a row's share of their sum is stationary: no steps are
    needed, and blocks of rows suffice.
    """
    if threshold is not None and not 0 <= threshold < 1:
        raise ValueError("threshold must be in [0, 1)")
    n, least = len(sentences), 1.0
    if not n:
        return np.zeros(0)
    plain, soft = np.zeros(n), np.zeros(n)
    for a, x in similarity_rows(*sentence_weights(sentences), n):
        x = x if threshold is None else (x >= threshold).astype(float)
        least = min(least, x.min())
        plain[a : a + len(x)], soft[a : a + len(x)] = x.sum(1), np.exp(x).sum(1)
    own = plain if least > 0 else soft
    return own * (n / own.sum())


def lexrank(df: DataFrame, threshold: float | None = None, id_col: str = "doc_id", sentences_col: str = "sentences") -> DataFrame:
    """``id, sent_no INT, score DOUBLE, sentence``: the centrality of each sentence of an array column. Row by row: no shuffle.

    A document of n sentences takes n² time, and memory in proportion to n.
    """
    kind = dict(df.dtypes)[id_col]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for doc, own in zip(frame["id"], frame["s"]):
                own = [] if own is None else [x or "" for x in own]
                if not own:
                    continue
                yield pd.DataFrame({"id": pd.Series([doc] * len(own), dtype=frame["id"].dtype), "sent_no": np.arange(len(own), dtype=np.int32), "score": np.round(sentence_centrality(own, threshold), 9), "sentence": own})

    return df.select(F.col(id_col).alias("id"), F.col(sentences_col).alias("s")).mapInPandas(run, f"id {kind}, sent_no int, score double, sentence string").withColumnRenamed("id", id_col)


def summary(scores: DataFrame, k: int = 5, id_col: str = "doc_id") -> DataFrame:
    """The ``k`` most central sentences of each document, with ``rank INT``; ties by place."""
    order = Window.partitionBy(id_col).orderBy(F.desc("score"), "sent_no")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
