"""N-gram dictionaries of a corpus, from plain or annotated lines."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.functions.lexicons import STOP_PAIR_WORDS, STOP_TAG_PAIRS
from quillon.functions.words import gram_counts
from quillon.sources.checkpoints import cut


def ngram_dictionary(
    df: DataFrame,
    tokens_col: str = "tokens",
    n: int = 2,
    scorer: str = "tf",
    by: str = "sentence",
    order_cols: Collection[str] = (),
    stop_tags: Collection[tuple[str, ...]] = STOP_TAG_PAIRS,
    stop_words: Collection[str] = STOP_PAIR_WORDS,
    longer_than: int | None = None,
) -> DataFrame:
    """``ngram ARRAY<STRING>, score, total BIGINT`` of all rows.

    ``tokens_col`` holds words, or structs ``word, pos``. ``by="sentence"`` keeps n-grams inside
    a row; ``by="all"`` lets them cross from a row to the next one in ``order_cols``.
    An n-gram is left out if its tags are among ``stop_tags`` or any of its words among ``stop_words``,
    in any case. ``longer_than`` drops shorter words beforehand. ``tf`` divides by the total that is left.
    """
    if scorer not in ("tf", "count") or by not in ("all", "sentence"):
        raise ValueError("scorer: tf or count; by: all or sentence")
    tagged = "struct" in dict(df.dtypes)[tokens_col]
    if not tagged:  # whole batches of words at a time
        return _scored(_plain_counts(df, tokens_col, n, by, list(order_cols), stop_words, longer_than), scorer)
    word = lambda t: t["word"]
    toks = F.filter(F.col(tokens_col), lambda t: F.length(word(t)) > longer_than) if longer_than is not None else F.col(tokens_col)
    if by == "all":
        rows = _across(df, toks, n, list(order_cols))
    else:
        rows = df.select(F.explode(_inside(toks, n)).alias("g"))
    words = F.transform("g", word)
    if stop_words:
        own = sorted({w.lower() for w in stop_words})
        rows = rows.where(~F.exists(words, lambda w: F.lower(w).isin(*own)))
    if tagged and (pairs := sorted({"\x1f".join(p).lower() for p in stop_tags if len(p) == n})):
        rows = rows.where(~F.lower(F.array_join(F.transform("g", lambda t: t["pos"]), "\x1f")).isin(*pairs))
    return _scored(rows.groupBy(words.alias("ngram")).agg(F.count("*").alias("_n")), scorer)


def _plain_counts(df: DataFrame, tokens_col: str, n: int, by: str, order_cols: list[str], stop_words: Collection[str], longer_than: int | None) -> DataFrame:
    """``ngram, _n`` of words without tags."""
    counts = gram_counts(df, tokens_col, n, stop_words, longer_than)
    if by == "all":
        toks = F.filter(F.col(tokens_col), lambda t: F.length(t) > longer_than) if longer_than is not None else F.col(tokens_col)
        cross = _across(df, toks, n, order_cols, inner=False)
        if cross is not None:
            # as rows of one n-gram, they go through the same step
            counts = counts.unionByName(gram_counts(cross, "g", n, stop_words))
    return counts.groupBy("ngram").agg(F.sum("n").alias("_n"))


def _scored(counted: DataFrame, scorer: str) -> DataFrame:
    total = counted.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("total"))
    score = F.col("_n") / F.col("total") if scorer == "tf" else F.col("_n")
    return counted.crossJoin(F.broadcast(total)).select("ngram", score.alias("score"), "total")  # total: one row


def _inside(toks, n: int):
    return T.let(toks, lambda t: F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - n + 1, F.lit(1))), lambda i: F.slice(t, i, n))))


def _across(df: DataFrame, toks, n: int, order_cols: list[str], inner: bool = True) -> DataFrame | None:
    """N-grams of the concatenation of all rows' tokens; those that cross alone without ``inner``, None if none can.

    Those inside a row come from the row alone. For those that cross, only the first and last
    n - 1 tokens of each row travel, once, range-partitioned in order; what a partition needs of
    the ones before it is a summary of n - 1 tokens a partition.
    """
    if not order_cols:
        raise ValueError('by="all" needs order_cols')
    own = df.select(*order_cols, toks.alias("t")).where(F.size("t") > 0)
    inside = own.select(F.explode(_inside(F.col("t"), n)).alias("g"))
    if n < 2:
        return inside if inner else None
    last = lambda c: F.slice(c, F.greatest(F.size(c) - n + 2, F.lit(1)), n - 1)
    ends = own.select(*order_cols, last("t").alias("tail"), F.slice("t", 1, n - 1).alias("head"))
    # the partition's number is part of the data from here on, so it is written, not computed again
    ends = cut(ends.repartitionByRange(*order_cols).withColumn("_p", F.spark_partition_id()))
    before = Window.partitionBy("_p").orderBy(*order_cols)
    # every row brings one token at least, so n - 1 rows before it suffice
    rows = ends.select("_p", "head", "tail", F.flatten(F.collect_list("tail").over(before.rowsBetween(-(n - 1), -1))).alias("own"), F.row_number().over(Window.partitionBy("_p").orderBy(*[F.desc(c) for c in order_cols])).alias("_back"))
    parts = rows.where("_back = 1").select("_p", last(F.concat("own", "tail")).alias("tail"))
    carried = parts.select("_p", F.flatten(F.collect_list("tail").over(Window.orderBy("_p").rowsBetween(-(n - 1), -1))).alias("carry"))  # a row a partition
    both = rows.join(F.broadcast(carried), "_p").select(last(F.concat("carry", "own")).alias("b"), "head").where(F.size("b") > 0)
    joined = F.concat("b", "head")
    # an n-gram that begins at place i (from 1) crosses if i <= |b| < i + n - 1
    first, final = F.greatest(F.size("b") - n + 2, F.lit(1)), F.least(F.size("b"), F.size(joined) - n + 1)
    cross = F.when(final >= first, F.transform(F.sequence(first, F.greatest(final, first)), lambda i: F.slice(joined, i, n)))
    crossing = both.select(F.explode(cross).alias("g"))
    return inside.unionByName(crossing) if inner else crossing


def plain_tokens(df: DataFrame, text_col: str = "text", sep: str | None = None, name: str = "tokens") -> DataFrame:
    """The frame with the tokens of a text in one more column."""
    return df.withColumn(name, T.tokens(text_col) if sep is None else T.split_on(text_col, sep))
