"""Dictionary scores of documents: TF, TF-IDF and its variants, word contributions.

A dictionary is a frame ``dimension, word`` (``rank`` where ranks count). Tokens meet its words before anything
is counted, so what is shuffled are counts of the words that matched, not of all words.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import tokens as K
from quillon.sources.checkpoints import small

#: Words of a dictionary that tokens are searched for as expressions, in a vague match.
PARTS = 200
METHODS = ("TFIDF", "WFIDF", "TFIDF+SIMWEIGHT", "WFIDF+SIMWEIGHT")


def _hint(df: DataFrame, fits: bool) -> DataFrame:
    """A broadcast hint if what bounds the frame has been found small; larger ones are joined by shuffle."""
    return F.broadcast(df) if fits else df


def dimensions(dictionary: DataFrame) -> list[str]:
    """Names of the dimensions in order: they become columns, so the driver needs them."""
    return [r[0] for r in dictionary.select("dimension").where("dimension is not null").distinct().orderBy("dimension").collect()]


def word_weights(dictionary: DataFrame) -> DataFrame:
    """``word, weight``: 1 / ln(2 + rank); of a word's ranks in several dimensions that of the last dimension counts."""
    return dictionary.groupBy("word").agg(T.similarity_weight(F.max_by("rank", F.struct("dimension", "rank"))).alias("weight"))


def counted_hits(df: DataFrame, dictionary: DataFrame, id_col: str = "doc_id", text_col: str = "text", vague: bool = False) -> DataFrame:
    """``id, word, n, dimensions ARRAY<STRING>``: how often each word of the dictionary is in each document, and its dimensions.

    Vague: words that hold a dictionary word. Of up to ``PARTS`` dictionary words each token is searched where it is, and
    what travels are counts of those that matched; of more, distinct words only are searched, then joined back by equality.
    """
    words = dictionary.select("dimension", "word").where("word is not null and dimension is not null").distinct()
    if vague and len(few := words.limit(PARTS + 1).collect()) <= PARTS:
        return _searched(df, [tuple(r) for r in few], id_col, text_col)
    fits = small(words)
    if vague:
        part = words.withColumnRenamed("word", "_part")
        every = df.select(F.explode(F.array_distinct(T.tokens(text_col))).alias("word")).distinct()
        words = every.join(_hint(part, fits), F.contains(F.col("word"), F.col("_part"))).select("word", "dimension")
    table = words.groupBy("word").agg(F.collect_set("dimension").alias("dimensions"))
    tokens = df.select(F.col(id_col), F.explode(T.tokens(text_col)).alias("word"))
    if vague:  # a common word meets the table once a document
        counted = tokens.groupBy(id_col, "word").agg(F.count("*").alias("n"))
        return counted.join(table, "word").select(id_col, "word", "n", "dimensions")
    found = tokens.join(_hint(table, fits), "word")
    return found.groupBy(id_col, "word").agg(F.count("*").alias("n"), F.first("dimensions").alias("dimensions"))


def _searched(df: DataFrame, parts: list[tuple[str, str]], id_col: str, text_col: str) -> DataFrame:
    """``counted_hits`` of words that hold one of a few parts, as expressions."""
    by_dimension: dict[str, list[str]] = {}
    for dimension, part in sorted(parts):
        by_dimension.setdefault(dimension, []).append(part)
    holds = lambda own: reduce(operator.or_, [F.contains(F.col("word"), F.lit(p)) for p in own], F.lit(False))
    counted = df.select(F.col(id_col), F.explode(T.tokens(text_col)).alias("word")).where(holds(sorted({p for _, p in parts}))).groupBy(id_col, "word").agg(F.count("*").alias("n"))
    dims = F.array_compact(F.array(*[F.when(holds(own), F.lit(d)) for d, own in by_dimension.items()])) if parts else F.array().cast("array<string>")
    return counted.select(id_col, "word", "n", dims.alias("dimensions"))


def _wide(hits: DataFrame, value: Column, lengths: DataFrame, dims: list[str], id_col: str, scale: bool, normalize: bool) -> DataFrame:
    sums = [F.sum(F.when(F.array_contains("dimensions", d), value)).alias(d) for d in dims]
    wide = hits.groupBy(id_col).agg(*sums) if dims else hits.select(id_col).distinct()
    out = lengths.join(wide, id_col, "left")
    scores: dict[str, Column] = {d: F.coalesce(F.col(f"`{d}`"), F.lit(0)).cast("double") for d in dims}
    if scale:
        scores = {d: F.try_divide(v, F.col("document_length")) for d, v in scores.items()}
    out = out.select(id_col, *[v.alias(d) for d, v in scores.items()], "document_length")
    if normalize and dims:
        norm = F.sqrt(sum((F.col(f"`{d}`") * F.col(f"`{d}`") for d in dims), F.lit(0.0)))
        out = out.withColumn("_norm", norm).select(id_col, *[F.when(F.col("_norm") > 0, F.col(f"`{d}`") / F.col("_norm")).otherwise(F.col(f"`{d}`")).alias(d) for d in dims], "document_length")
    return out


def tf_scores(df: DataFrame, dictionary: DataFrame, id_col: str = "doc_id", text_col: str = "text", scale: bool = False, vague: bool = False) -> DataFrame:
    """``id, <dimensions in order> DOUBLE, document_length INT`` for every document.

    A word in several dimensions counts in each. ``scale`` divides by the length (null for an empty document).
    """
    hits = counted_hits(df, dictionary, id_col, text_col, vague)
    return _wide(hits, F.col("n"), K.document_lengths(df, id_col, text_col), dimensions(dictionary), id_col, scale, False)


def _value(method: str) -> Column:
    """The weight of ``n`` occurrences of a word that ``df`` of ``n_docs`` documents have, by natural logarithms, unsmoothed."""
    n = F.col("n").cast("double")
    if method == "TF":
        return n
    value = (n if method.startswith("TF") else 1 + F.log(n)) * F.log(F.col("n_docs") / F.col("df"))
    return value * F.col("_weight") if method.endswith("SIMWEIGHT") else value


def _with_frequencies(df: DataFrame, dictionary: DataFrame, weights: DataFrame | None, id_col: str, text_col: str, vague: bool, weighted: bool) -> DataFrame:
    """``counted_hits`` with ``df, n_docs`` and, for weighted methods, ``_weight``."""
    hits = counted_hits(df, dictionary, id_col, text_col, vague)
    fits = small(dictionary.select("dimension", "word"))
    # a row a document and word that matched: frequencies are counted on them; there are no more than words in the dictionary
    hits = hits.join(_hint(hits.groupBy("word").agg(F.count("*").alias("df")), fits and not vague), "word")
    total = df.agg(F.count_distinct(F.col(id_col)).alias("n_docs"))
    hits = hits.crossJoin(F.broadcast(total))  # one row
    if weighted:
        own = (weights if weights is not None else word_weights(dictionary)).select("word", F.col("weight").alias("_weight"))
        hits = hits.join(_hint(own, fits if weights is None else small(own)), "word")
    return hits


def _checked(method: str) -> str:
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    return method


def weighted_terms(df: DataFrame, dictionary: DataFrame, method: str = "TFIDF", weights: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", vague: bool = False) -> DataFrame:
    """``id, dimension, word, n, value``: the weight of each matched word."""
    hits = _with_frequencies(df, dictionary, weights, id_col, text_col, vague, _checked(method).endswith("SIMWEIGHT"))
    return hits.select(id_col, F.explode("dimensions").alias("dimension"), "word", "n", _value(method).alias("value"))


def tfidf_scores(df: DataFrame, dictionary: DataFrame, method: str = "TFIDF", weights: DataFrame | None = None, scale: bool = True, normalize: bool = False, vague: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, <dimensions> DOUBLE, document_length``; ``normalize`` divides by the L2 norm over the dimensions (after scaling)."""
    hits = _with_frequencies(df, dictionary, weights, id_col, text_col, vague, _checked(method).endswith("SIMWEIGHT"))
    return _wide(hits, _value(method), K.document_lengths(df, id_col, text_col), dimensions(dictionary), id_col, scale, normalize)


def word_contributions(df: DataFrame, dictionary: DataFrame, method: str = "TFIDF", weights: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", vague: bool = False) -> DataFrame:
    """``word, contribution``: over documents and dimensions, the sum of weight / document length."""
    hits = weighted_terms(df, dictionary, method, weights, id_col, text_col, vague)
    return hits.join(K.document_lengths(df, id_col, text_col), id_col).groupBy("word").agg(F.sum(F.col("value") / F.col("document_length")).alias("contribution"))


def contribution_table(df: DataFrame, dictionary: DataFrame, weights: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``method, dimension, word, rank INT, contribution, share, cumulative_share`` for TF and the four weightings.

    Contributions aren't divided by lengths. Ranks: greatest first, then by word. All methods come from one pass over the texts.
    """
    hits = _with_frequencies(df, dictionary, weights, id_col, text_col, False, True)
    methods = ("TF", *METHODS)
    sums = hits.groupBy("word", "dimensions").agg(*[F.sum(_value(m)).alias(m) for m in methods])
    every = F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"`{m}`").alias("contribution")) for m in methods])
    by_word = sums.select("word", "dimensions", F.explode(every).alias("v")).select(F.explode("dimensions").alias("dimension"), "word", "v.*")
    part = Window.partitionBy("method", "dimension")
    order = part.orderBy(F.desc("contribution"), "word")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return by_word.select(
        "method", "dimension", "word",
        F.row_number().over(order).alias("rank"),
        "contribution",
        F.try_divide("contribution", F.sum("contribution").over(part)).alias("share"),
        F.try_divide(F.sum("contribution").over(running), F.sum("contribution").over(part)).alias("cumulative_share"),
    )
