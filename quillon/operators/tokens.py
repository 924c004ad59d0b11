"""Token-level aggregates: counts in documents, document frequencies, regrouped sentences, TF-IDF vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.functions.words import runs, split_words
from quillon.sources.checkpoints import small


def explode_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, pos INT, word``: a row for each token, positions from 0."""
    return df.select(F.col(id_col), F.posexplode(T.tokens(text_col)).alias("pos", "word"))


def term_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, word, n``: how often each word occurs in each document.

    Documents of one id count together. The partial aggregation runs before the shuffle.
    """
    return df.select(F.col(id_col), F.explode(T.tokens(text_col)).alias("word")).groupBy(id_col, "word").agg(F.count("*").alias("n"))


def document_frequency(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``word, df``: the number of rows whose text holds the word. One shuffle of distinct words."""
    return df.select(F.explode(F.array_distinct(T.tokens(text_col))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))


def document_lengths(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, document_length INT``: the number of tokens."""
    return df.select(id_col, F.coalesce(F.size(T.tokens(text_col)), F.lit(0)).alias("document_length"))


def regroup_sentences(df: DataFrame, id_col: str = "sent_id", text_col: str = "text", sep: str = " ") -> DataFrame:
    """``doc_id, text, n_sentences INT``: sentences ``{doc}_{number}`` joined into documents, by number, then text.

    Ids without ``_`` all belong to the document null.
    """
    own = df.select(T.document_part(id_col).alias("doc_id"), F.struct(T.sentence_number(id_col).alias("at"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("s"))
    return own.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["text"]), sep).alias("text"), F.count("*").cast("int").alias("n_sentences"))


def tfidf_vectors(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, word, weight``: tf * log2(N / df), divided by the document's L2 norm; zero weights are left out.

    N counts the documents. Counts meet their frequencies by one shuffle by word, and their document by one by id; where
    ids are those of one row each, as one look at the ids tells, counts themselves need none.
    """
    tc = _counts_in_rows(df, id_col, text_col) if _one_row_each(df, id_col) else term_counts(df, id_col, text_col)
    n = df.agg(F.count_distinct(F.col(id_col)).alias("n_docs"))
    every = tc.withColumn("df", F.count("*").over(Window.partitionBy("word")))
    raw = every.crossJoin(F.broadcast(n)).select(id_col, "word", (F.col("n") * F.log2(F.col("n_docs") / F.col("df"))).alias("raw")).where("raw > 0")  # n: one row
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(id_col)))
    return raw.select(id_col, "word", (F.col("raw") / norm).alias("weight"))


def _one_row_each(df: DataFrame, id_col: str) -> bool:
    return not df.groupBy(F.col(id_col).alias("i")).count().where("count > 1").limit(1).collect()


def _counts_in_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``term_counts`` of rows that are a document each, without a shuffle."""
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in runs(batch.column(1)):
                offsets, words = split_words(batch.column(1).slice(first, last - first))
                if not len(words):
                    continue
                own = words.dictionary_encode()
                row = np.repeat(np.arange(first, last), np.diff(offsets))
                key, count = np.unique(row * len(own.dictionary) + own.indices.to_numpy(), return_counts=True)
                row, word = np.divmod(key, len(own.dictionary))
                for at in range(0, len(key), 100_000):
                    some = slice(at, at + 100_000)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[some])), own.dictionary.take(pa.array(word[some])), pa.array(count[some])], names=[id_col, "word", "n"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, word string, n long")


def cosine_join(x: DataFrame, y: DataFrame, x_id: str = "x", y_id: str = "y") -> DataFrame:
    """``x, y, score`` of all pairs that share a word, from two frames ``id, word, weight`` with unit vectors."""
    a = x.select(F.col(x_id).alias("x"), "word", F.col("weight").alias("wx"))
    b = y.select(F.col(y_id).alias("y"), "word", F.col("weight").alias("wy"))
    return a.join(b, "word").groupBy("x", "y").agg(F.sum(F.col("wx") * F.col("wy")).alias("score"))


def similarity_matrix(x: DataFrame, y: DataFrame, model: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``x, y, score`` of every pair of documents, zeros too.

    ``model`` has ``word, idf``; without one it is learned from ``y``. Words that it lacks are ignored.
    The result has |x| * |y| rows by definition; ``cosine_join`` gives the sparse one.
    """
    if model is None:
        model = idf_model(y, id_col, text_col)

    fits = small(model)

    def vectors(df: DataFrame) -> DataFrame:
        # words meet the model before they are counted
        rows = df.select(F.col(id_col), F.explode(T.tokens(text_col)).alias("word"))
        found = rows.join(F.broadcast(model.select("word", "idf")), "word").groupBy(id_col, "word", "idf").agg(F.count("*").alias("n")) if fits else term_counts(df, id_col, text_col).join(model, "word")
        raw = found.select(id_col, "word", (F.col("n") * F.col("idf")).alias("raw")).where("raw > 0")
        norm = raw.groupBy(id_col).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
        return raw.join(norm, id_col).select(id_col, "word", (F.col("raw") / F.col("norm")).alias("weight"))

    vx, vy = vectors(x), vectors(y)
    hits = cosine_join(vx, F.broadcast(vy) if small(vy) else vy, id_col, id_col)
    # the scores of a document travel in one row, and zeros are made where the result is
    scores = hits.where("y is not null").groupBy("x").agg(F.map_from_entries(F.collect_list(F.struct("y", "score"))).alias("_s"))
    every = x.select(F.col(id_col).alias("x")).join(scores, "x", "left").crossJoin(F.broadcast(y.select(F.col(id_col).alias("y"))) if small(y.select(id_col)) else y.select(F.col(id_col).alias("y")))
    return every.select("x", "y", F.coalesce(F.try_element_at("_s", F.col("y")), F.lit(0.0)).alias("score"))


def idf_model(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, df, idf`` with idf = log2(N / df)."""
    n = df.agg(F.count_distinct(F.col(id_col)).alias("n_docs"))
    return term_counts(df, id_col, text_col).groupBy("word").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("word", "df", F.log2(F.col("n_docs") / F.col("df")).alias("idf"))
