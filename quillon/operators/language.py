"""Language of texts by naive Bayes over character n-grams: texts are cleaned in the JVM, n-grams counted and looked up in whole batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.words import runs
from quillon.sources.checkpoints import cut, small

#: Letters of an n-gram that one number holds, bytes of text that are coded at once, distinct n-grams up to which a table is looked up.
LONGEST, CHARACTERS, DENSE = 3, 4 << 20, 1 << 22
RESULTS = ("max", "max_prob", "all", "all_prob")


def _plain(text: Column) -> Column:
    return F.concat(F.lit(" "), F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[\s\d\p{P}\p{S}]+", " "))), F.lit(" "))


def _grams(text: Column, n: int) -> Column:
    # a pattern that looks ahead walks the text once; a substring for each place would walk it each time
    return F.regexp_extract_all(_plain(text), F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


def _coded(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct n-grams as numbers of 21 bits a character, which of them each place begins, n-grams of each text)."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    letters = np.flatnonzero(np.bincount(codes, minlength=1))
    number = np.zeros(int(letters[-1]) + 1 if len(letters) else 1, np.int64)
    number[letters] = np.arange(len(letters))
    inside = np.arange(len(codes)) + n <= np.repeat(np.cumsum(size), size)
    at, base = np.flatnonzero(inside), max(len(letters), 1)
    key = np.zeros(len(at), np.int64)
    small_codes = number[codes]
    for k in range(n):
        key = key * base + small_codes[at + k]
    if base**n <= DENSE:
        own = np.flatnonzero(np.bincount(key, minlength=1)) if len(key) else key
        place = np.zeros(base**n, np.int64)
        place[own] = np.arange(len(own))
        which = place[key]
    else:
        own, which = np.unique(key, return_inverse=True)
    grams = np.zeros(len(own), np.int64)
    for k in range(n):
        grams |= letters[own // base ** (n - 1 - k) % base] << (21 * (n - 1 - k))
    return grams, which, np.maximum(size - n + 1, 0)


def _counted(df: DataFrame, n: int) -> DataFrame:
    """``lang, gram, n`` of a frame ``lang, text``, partial counts of some megabytes of text each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in runs(batch.column(1), CHARACTERS):
                langs = batch.column(0).slice(first, last - first).dictionary_encode()
                grams, which, size = _coded(batch.column(1).slice(first, last - first).to_pylist(), n)
                lang = np.repeat(langs.indices.to_numpy(), size)
                for i, name in enumerate(langs.dictionary.to_pylist()):
                    count = np.bincount(which[lang == i], minlength=len(grams))
                    some = np.flatnonzero(count)
                    text = ["".join(chr(int(g) >> 21 * (n - 1 - k) & 0x1FFFFF) for k in range(n)) for g in grams[some]]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(text, pa.string()), pa.array(count[some])], names=["lang", "gram", "n"])

    return df.mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _summed(df: DataFrame, known: DataFrame, langs: int, n: int, id_col: str) -> DataFrame:
    """``id, _s0 ..``: the gains of each document's known n-grams summed, null where it has none, of a frame ``id, text``."""
    own = known.toArrow()
    keys = np.array([sum(ord(c) << 21 * (n - 1 - k) for k, c in enumerate(g)) for g in own["gram"].to_pylist()], np.int64)
    order = np.argsort(keys)
    gains = np.stack([own[f"_l{i}"].to_numpy()[order] for i in range(langs)]) if len(keys) else np.zeros((langs, 0))
    shared = df.sparkSession.sparkContext.broadcast((keys[order], gains))
    names = [f"_s{i}" for i in range(langs)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, gains = shared.value
        for batch in batches:
            for first, last in runs(batch.column(1), CHARACTERS):
                grams, which, size = _coded(batch.column(1).slice(first, last - first).to_pylist(), n)
                at = np.minimum(np.searchsorted(keys, grams), max(len(keys) - 1, 0))
                hit = keys[at] == grams if len(keys) else np.zeros(len(grams), bool)
                text = np.repeat(np.arange(last - first), size)
                some = np.bincount(text, hit[which], last - first) > 0
                sums = [np.bincount(text, np.where(hit, g[at], 0.0)[which] if len(keys) else np.zeros(len(which)), last - first) for g in gains]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), *[pa.array(s, mask=~some) for s in sums]], names=[id_col, *names])

    out = df.mapInArrow(run, f"`{id_col}` {dict(df.dtypes)[id_col]}, " + ", ".join(f"{s} double" for s in names))
    return out.groupBy(id_col).agg(*[F.sum(s).alias(s) for s in names])


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", n: int = 2, rows: int | None = None) -> DataFrame:
    """``lang, gram, log_p``: smoothed log likelihoods of the corpus's n-grams for each language; ``rows`` keeps the commonest only.

    ``gram`` null holds what an unseen n-gram costs.
    """
    own = df.where(F.col(lang_col).isNotNull())
    if n <= LONGEST:
        counted = _counted(own.select(F.col(lang_col).alias("lang"), _plain(F.col(text_col)).alias("text")), n)
    else:
        counted = own.select(F.col(lang_col).alias("lang"), F.explode(_grams(F.col(text_col), n)).alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("n"))
    if rows is not None:
        kept = counted.groupBy("gram").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "gram").limit(rows).select("gram")
        counted = counted.join(kept, "gram")
    total = counted.groupBy("lang").agg(F.sum("n").alias("total"), F.count("*").alias("v"))
    size = F.lit(rows) if rows is not None else F.col("size")
    if rows is None:
        total = total.crossJoin(F.broadcast(counted.select("gram").distinct().agg(F.count("*").alias("size"))))  # one row
    p = counted.join(F.broadcast(total), "lang").select("lang", "gram", F.log((F.col("n") + 0.5) / (F.col("total") + 0.5 * size)).alias("log_p"))  # total: a row a language
    return cut(p.unionByName(total.select("lang", F.lit(None).cast("string").alias("gram"), F.log(0.5 / (F.col("total") + 0.5 * size)).alias("log_p"))))


def detect(df: DataFrame, model: DataFrame, result: str = "max", n: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, languages``: the likeliest language (``max``), with its probability (``max_prob``), or all by probability.

    A text without a known n-gram has null. Where the model can be broadcast, n-grams of up to three letters meet it
    in their text's row, and only sums by document travel; else they are counted within a document before they meet it by shuffle.
    """
    if result not in RESULTS:
        raise ValueError(f"result must be one of {RESULTS}")
    low = {r["lang"]: r["log_p"] for r in model.where("gram is null").collect()}  # a row a language
    langs = sorted(low)
    if not langs:
        raise ValueError("a model without languages")
    # what each language gains from an n-gram that it knows, over an unseen one
    known = model.where("gram is not null").groupBy("gram").agg(*[F.coalesce(F.max(F.when(F.col("lang") == x, F.col("log_p"))), F.lit(low[x])).alias(f"_l{i}") for i, x in enumerate(langs)])
    grams = df.select(F.col(id_col), F.explode(_grams(F.col(text_col), n)).alias("gram"))
    fits = small(model)
    if fits and n <= LONGEST:
        sums = _summed(df.select(id_col, _plain(F.col(text_col)).alias("text")), known, len(langs), n, id_col).where("_s0 is not null")
    else:
        if fits:
            hits = grams.withColumn("n", F.lit(1)).join(F.broadcast(known), "gram")
        else:
            hits = grams.groupBy(id_col, "gram").agg(F.count("*").alias("n")).join(known, "gram")
        sums = hits.groupBy(id_col).agg(*[F.sum(F.col("n") * F.col(f"_l{i}")).alias(f"_s{i}") for i in range(len(langs))])
    every = sums.select(id_col, F.array(*[F.struct(F.col(f"_s{i}").alias("s"), F.lit(x).alias("lang")) for i, x in enumerate(langs)]).alias("x"))
    every = every.withColumn("top", F.array_max(F.transform("x", lambda v: v["s"])))
    every = every.withColumn("z", F.aggregate("x", F.lit(0.0), lambda acc, v: acc + F.exp(v["s"] - F.col("top"))))
    ordered = F.array_sort("x", lambda a, b: F.when(a["s"] > b["s"], -1).when(a["s"] < b["s"], 1).when(a["lang"] < b["lang"], -1).when(a["lang"] > b["lang"], 1).otherwise(0))
    full = F.transform(ordered, lambda v: F.struct(v["lang"].alias("lang"), (F.exp(v["s"] - F.col("top")) / F.col("z")).alias("prob")))
    value = {"all_prob": full, "all": F.transform(full, lambda v: v["lang"]), "max": F.get(full, 0)["lang"], "max_prob": F.get(full, 0)}[result]
    return df.select(id_col).distinct().join(every.select(id_col, value.alias("languages")), id_col, "left")


def without_languages(df: DataFrame, langs_col: str, unwanted: list[str]) -> DataFrame:
    """Rows whose array of languages has none of ``unwanted``."""
    return df.where(~F.arrays_overlap(F.col(langs_col), F.lit(list(unwanted))))
