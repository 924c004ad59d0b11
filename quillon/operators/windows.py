"""Windows over a document's own tokens and sentences, in arrays: no shuffle, and streamable."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Collection, Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as T


def paragraph_windows(df: DataFrame, patterns: Sequence[str], window: int, merge: bool = True, ignore_case: bool = True, id_col: str = "doc_id", sentences_col: str = "sentences") -> DataFrame:
    """``id, start INT, end INT`` (end excluded) of the windows of sentences in which every pattern is found.

    ``merge`` joins windows that overlap; adjacent ones stay apart. Documents with fewer
    sentences than the window give no rows. A null sentence matches nothing.
    """
    if window <= 0 or not patterns:
        raise ValueError("a positive window and at least one pattern are needed")
    flag = "(?i)" if ignore_case else ""
    s = F.col(sentences_col)
    base = df.select(F.col(id_col), F.size(s).alias("_n"), *[_found(s, flag + p).alias(f"_h{k}") for k, p in enumerate(patterns)]).where(F.col("_n") >= window)
    starts = F.sequence(F.lit(0), F.col("_n") - window)
    ok = lambda i: reduce(and_, [F.exists(F.slice(F.col(f"_h{k}"), i + 1, window), lambda b: b) for k in range(len(patterns))])
    good = F.filter(starts, ok)
    if not merge:
        return base.select(id_col, F.explode(F.transform(good, lambda i: F.struct(i.alias("start"), (i + window).alias("end")))).alias("w")).select(id_col, "w.start", "w.end")
    # a window that begins a group is a whole window or more behind the one before it, one that ends it before the next one
    far = lambda x, y: x.isNull() | y.isNull() | (y - x >= window)

    def merged(g: Column) -> Column:
        before = F.concat(F.array(F.lit(None).cast("int")), g)  # the last one is of no use, zip_with makes it a null pair
        after = F.slice(g, 2, F.greatest(F.size(g), F.lit(1)))
        pairs = lambda x, y: F.zip_with(x, y, lambda p, q: F.struct(p.alias("p"), q.alias("q")))
        first = F.filter(pairs(before, g), lambda v: v["q"].isNotNull() & far(v["p"], v["q"]))
        last = F.filter(pairs(g, after), lambda v: far(v["p"], v["q"]))
        return F.zip_with(first, last, lambda f, t: F.struct(f["q"].alias("start"), (t["p"] + window).alias("end")))

    return base.select(id_col, F.explode(T.let(good, merged)).alias("w")).select(id_col, "w.start", "w.end")


def _found(sentences: Column, pattern: str) -> Column:
    return F.transform(sentences, lambda x: F.coalesce(x.rlike(pattern), F.lit(False)))


def topic_windows(
    df: DataFrame,
    topics: Mapping[str, Mapping[tuple[str, ...], float]],
    subjects: Mapping[str, set[str]],
    n: int = 2,
    window: int = 20,
    binary_subjects: Sequence[str] = (),
    scale: bool = True,
    multiplier: float = 100_000,
    sep: str = " ",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Counts and window scores of topics (weighted n-grams) near subjects (word sets), a row for each document.

    Columns: ``id, total_words INT, subject_count_<s>, topic_ngram_count_<t>,
    topic_ngram_count_weighted_<t>, topic_subject_score_<t>_<s>``. A window is ``window + 1``
    neighbouring n-grams around a centre; only whole windows count. A topic's n-gram at the
    centre adds its weight, times the number of the subject's distinct words in the window (for
    ``binary_subjects`` 1 if there are any). ``scale`` divides all but total_words by it (null for none).
    """
    if unknown := set(binary_subjects) - set(subjects):
        raise ValueError(f"unknown subjects: {sorted(unknown)}")
    centre = window // 2
    words = T.split_on(text_col, sep)
    base = df.select(F.col(id_col), words.alias("_w"))
    total = F.size("_w")
    grams = total - n + 1
    # places (from 1) of n-grams that are the centre of a whole window
    places = F.when(grams > window, F.sequence(F.lit(centre + 1), F.greatest(grams - window + centre, F.lit(centre + 1)))).otherwise(F.array().cast("array<int>"))
    glue = "\x1f"
    centred = F.transform(places, lambda p: F.struct(F.array_join(F.slice(F.col("_w"), p, n), glue).alias("g"), p.alias("p")))
    base = base.select(id_col, "_w", centred.alias("_c"))
    tables = [_lookup({glue.join(g): float(w) for g, w in weights.items()}) for weights in topics.values()]
    members = {s: _member(own) for s, own in subjects.items()}
    known = lambda table: F.filter("_c", lambda c: table(c["g"]).isNotNull())
    base = base.select(id_col, "_w", *[known(t).alias(f"_t{k}") for k, t in enumerate(tables)])
    factor = F.try_divide(F.lit(float(multiplier)), total) if scale else F.lit(float(multiplier))
    out: list[Column] = [total.alias("total_words")]
    out += [(F.size(F.filter("_w", own)) * factor).alias(f"subject_count_{s}") for s, own in members.items()]
    for k, (t, table) in enumerate(zip(topics, tables)):
        hits = F.col(f"_t{k}")
        out.append((F.size(hits) * factor).alias(f"topic_ngram_count_{t}"))
        out.append((_total(hits, table, None) * factor).alias(f"topic_ngram_count_weighted_{t}"))
        for s, own in members.items():
            near = _near("_w", centre, window + n, own, s in binary_subjects)
            out.append((_total(hits, table, near) * factor).alias(f"topic_subject_score_{t}_{s}"))
    return base.select(id_col, *out)


def _lookup(table: Mapping[str, float]) -> Callable[[Column], Column]:
    """The value of a key, null for another one: a literal array of small maps by checksum, for a map is searched from its begin."""
    size = 1 << max(0, len(table).bit_length() - 1)
    maps: list[dict[str, float]] = [{} for _ in range(size)]
    for k, v in table.items():
        maps[zlib.crc32(k.encode()) % size][k] = v
    own = F.from_json(F.lit(json.dumps(maps)), "array<map<string,double>>")
    return lambda key: F.get(own, F.pmod(F.crc32(key.cast("binary")), F.lit(size)).cast("int"))[key]


def _member(own: Collection[str]) -> Callable[[Column], Column]:
    """Whether a word is one of these: a set of literals if they are few."""
    if len(own) > 200:
        table = _lookup(dict.fromkeys(own, 1.0))
        return lambda w: table(w).isNotNull()
    keys = sorted(own)
    return lambda w: w.isin(*keys) if keys else F.lit(False)


def _near(words: str, before: int, size: int, own: Callable[[Column], Column], binary: bool) -> Callable[[Column], Column]:
    """How many distinct words of a subject are in the window around a centre; 1 or 0 if ``binary``."""

    def count(centre: Column) -> Column:
        n = F.size(F.array_distinct(F.filter(F.slice(F.col(words), centre["p"] - before, size), own)))
        return (n > 0).cast("double") if binary else n

    return count


def _total(hits: Column, table: Callable[[Column], Column], count: Callable[[Column], Column] | None) -> Column:
    return F.aggregate(hits, F.lit(0.0), lambda acc, c: acc + table(c["g"]) * (count(c) if count else F.lit(1.0)))
