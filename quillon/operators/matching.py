"""Fuzzy matching of two lists of strings, whole or within groups, and picks from score tables.

Scorers: ``levenshtein`` and ``ratio`` (indel), both from 0 to 100, compare blocks of queries with blocks
of choices in vectorised Python, but for all pairs with their scores ``levenshtein`` stays in the JVM as a
join with an expression; a function of two equally long series of strings is applied to blocks as well. Each block meets each one of its group
once, so a task's memory is bounded whatever the sizes, and leaves no more than each query's best. Where ``ratio`` has a least score
or a number of best ones, choices are a trie that is searched for all queries of a block at once, and most pairs are never looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.similarity import Choices, Tries, levenshtein_ratio, rank_in

#: Strings of a block of queries at most, and of a block of choices.
QUERY_BLOCK, CHOICE_BLOCK = 5_000, 50_000
#: The same where choices are searched as tries: of strings of up to ``Tries.MOST`` letters, fewer of longer ones.
SEARCH_QUERIES, SEARCH_CHOICES = 100_000, 400_000
#: Scores that are held at once where choices are gone through.
CELLS = 1 << 22
#: A name, or a function from series of queries and choices to their scores.
Scorer = str | Callable[[pd.Series, pd.Series], pd.Series]
PREDICATES = {"greater_equal": lambda x, t: x >= t, "greater": lambda x, t: x > t, "less": lambda x, t: x < t, "less_equal": lambda x, t: x <= t}


def clean(df: DataFrame, value_col: str, groups: Sequence[str] = ()) -> DataFrame:
    """Distinct strings without nulls, by group; rows with a null group are dropped."""
    own = df.select(*groups, F.col(value_col).cast("string").alias("_v"))
    return own.dropna().distinct()


def _score(left: str, choices: np.ndarray, table: Choices | None, scorer: Scorer, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(choice, score) of one query, those below ``least`` left out."""
    if table is not None:
        at, value = table.ratios(left, least) if scorer == "ratio" else table.levenshtein_ratios(left)
    else:
        at, value = np.arange(len(choices)), np.asarray(scorer(pd.Series([left] * len(choices), dtype=object), pd.Series(choices, dtype=object)), np.float64)
    keep = value >= least - 1e-9 if least > 0 else ~np.isnan(value)
    return at[keep], value[keep]


def _scores(queries: np.ndarray, choices: np.ndarray, scorer: Scorer, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``_score`` of each query in turn. Distances are the same both ways: what there is less of is gone through, the rest is the vector."""
    if scorer != "levenshtein" or len(choices) >= len(queries):
        table = Choices(choices.tolist()) if scorer in ("ratio", "levenshtein") else None
        for s in queries:
            yield _score(s, choices, table, scorer, least)
        return
    every, step = np.arange(len(choices)), max(1, CELLS // len(choices))
    for first in range(0, len(queries), step):
        table = Choices(queries[first : first + step].tolist())
        value = np.empty((len(table.size), len(choices)))
        for j, c in enumerate(choices):
            at, own = table.levenshtein_ratios(c)
            value[at, j] = own
        for row in value:
            keep = row >= least - 1e-9 if least > 0 else slice(None)
            yield every[keep], row[keep]


def _searched(queries: np.ndarray, choices: list[str], least: float, k: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, choice, score) by indel ratio: through tries, and one by one where a query or choices are too long or nothing can be left out."""
    short = np.fromiter((len(c) <= Tries.MOST for c in choices), bool, len(choices))
    near, far = np.flatnonzero(short), np.flatnonzero(~short)
    own, at, value, given_up = Tries([choices[i] for i in near]).nearest(queries.tolist(), least, k)
    parts = [(own, near[at], value)]
    rest = np.zeros(len(queries), bool)
    rest[given_up] = True
    for strings, left in ((near, np.flatnonzero(rest)), (far, np.arange(len(queries)))):
        table = Choices([choices[i] for i in strings]) if len(strings) and len(left) else None
        for i in left if table else ():
            x, r = _score(queries[i], strings, table, "ratio", least)
            x, r = _best(x, r, k) if k is not None else (x, r)
            parts.append((np.full(len(x), i), strings[x], r))
    own, at, value = (np.concatenate(x) for x in zip(*parts))
    if k is None or len(parts) == 1:
        return own, at, value
    order = np.lexsort((at, -value, own))
    order = order[rank_in(own[order]) < k]
    return own[order], at[order], value[order]


def _best(at: np.ndarray, value: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` greatest; of equal ones the first."""
    if len(at) > k:
        bound = np.partition(value, len(value) - k)[len(value) - k]
        keep = value >= bound
        at, value = at[keep], value[keep]
    order = np.lexsort((at, -value))[:k]
    return at[order], value[order]


def _blocked(q: DataFrame, c: DataFrame, groups: list[str], scorer: Scorer, least: float, k: int | None, passes: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Scores of all pairs by blocks; with ``k`` the best of each query in each block of choices only; with ``passes`` only the number of those that pass."""
    cores = q.sparkSession.sparkContext.defaultParallelism
    search = scorer == "ratio" and passes is None and (k is not None or least > 0)

    def sized(df: DataFrame, value: str, size: int, name: str, least_blocks: int) -> DataFrame:
        # small tables are cut into a block a core; strings that are longer than a trie's are as many as fit in its place
        longer = F.greatest(F.lit(1.0), F.max(F.length(value)) / Tries.MOST) if search else F.lit(1.0)
        blocks = F.greatest(F.ceil(F.count("*") * longer / size), F.least(F.lit(least_blocks), F.ceil(F.count("*") / 64))).cast("int")
        count = df.groupBy(*groups).agg(blocks.alias(f"{name}s"))
        joined = df.join(count, groups) if groups else df.crossJoin(F.broadcast(count))  # without groups: one row
        return joined.withColumn(name, F.pmod(F.xxhash64(value), F.col(f"{name}s")).cast("int"))

    sizes = (SEARCH_QUERIES, SEARCH_CHOICES) if search else (QUERY_BLOCK, CHOICE_BLOCK)
    qb, cb = sized(q, "origin_query", sizes[0], "_qb", 1 if groups else 2 * cores), sized(c, "match_list", sizes[1], "_cb", 1)
    n_q, n_c = qb.select(*groups, "_qbs").distinct(), cb.select(*groups, "_cbs").distinct()
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    meet = (lambda a, b: a.join(b, groups)) if groups else (lambda a, b: a.crossJoin(F.broadcast(b)))  # one row again
    q_all = meet(qb, n_c).withColumn("_cb", every("_cbs")).select(*groups, "_qb", "_cb", "origin_query")
    c_all = meet(cb, n_q).withColumn("_qb", every("_qbs")).select(*groups, "_qb", "_cb", "match_list")
    kinds = dict(q.dtypes)
    values = {"origin_query": "string"} | ({"links": "long"} if passes else {"match_list": "string", "match_score": "double"})
    schema = ", ".join([f"`{g}` {kinds[g]}" for g in groups] + [f"{n} {t}" for n, t in values.items()])
    names = [*groups, *values]

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({n: [] for n in names})
        strings = np.array(sorted(right["match_list"]), object)  # in order, so that the first of equals is the first by text
        queries = left["origin_query"].to_numpy()
        if passes:
            links = [int(passes(value).sum()) for _, value in _scores(queries, strings, scorer, least)]
            return pd.DataFrame({"origin_query": queries, "links": links}).assign(**dict(zip(groups, key)))[names].query("links > 0")
        if search:
            own, at, value = _searched(queries, strings.tolist(), least, k)
            return pd.DataFrame({"origin_query": queries[own], "match_list": strings[at], "match_score": value}).assign(**dict(zip(groups, key)))[names]
        own, at, value = [], [], []
        for i, (x, r) in enumerate(_scores(queries, strings, scorer, least)):
            if k is not None:
                x, r = _best(x, r, k)
            own.append(np.full(len(x), i))
            at.append(x)
            value.append(r)
        out = pd.DataFrame({"origin_query": queries[np.concatenate(own)], "match_list": strings[np.concatenate(at)], "match_score": np.concatenate(value)})
        for g, v in zip(groups, key):
            out[g] = v
        return out[names]

    keys = [*groups, "_qb", "_cb"]
    if search:  # blocks are few bytes and much work: by its number of partitions the engine doesn't put them together
        q_all, c_all = (df.repartition(4 * cores, *keys) for df in (q_all, c_all))
    return q_all.groupBy(*keys).cogroup(c_all.groupBy(*keys)).applyInPandas(run, schema)


def _cleaned(queries: DataFrame, choices: DataFrame, query_col: str, choice_col: str, groups: list[str], drop_first_group: bool) -> tuple[DataFrame, DataFrame]:
    q, c = clean(queries, query_col, groups).withColumnRenamed("_v", "origin_query"), clean(choices, choice_col, groups).withColumnRenamed("_v", "match_list")
    if drop_first_group and groups:
        first = c.agg(F.min(F.struct(*groups)).alias("f"))
        c = c.crossJoin(F.broadcast(first)).where(F.struct(*groups) != F.col("f")).drop("f")  # one row
    return q, c


def panel(queries: DataFrame, choices: DataFrame, query_col: str, choice_col: str, groups: Sequence[str] = (), scorer: Scorer = "ratio", least: float = 0.0, best_of: int | None = None, drop_first_group: bool = False) -> DataFrame:
    """``<groups>, origin_query, match_list, match_score`` of all pairs (of a group) that can score ``least``.

    A result of |queries| * |choices| rows by definition where ``least`` is 0. ``best_of`` lets blocks leave
    out what isn't among a query's best there; scores of NaN are left out always. ``drop_first_group``
    leaves out the least group of the choices, as an older implementation did.
    """
    groups = list(groups)
    q, c = _cleaned(queries, choices, query_col, choice_col, groups, drop_first_group)
    if scorer == "levenshtein" and best_of is None:
        pairs = q.join(c, groups) if groups else q.crossJoin(c)
        if least > 0:  # the distance is at least the difference of lengths
            a, b = F.length("origin_query"), F.length("match_list")
            pairs = pairs.where(F.least(a, b) * 100.0 >= F.greatest(a, b) * least - 1e-6)
        out = pairs.select(*groups, "origin_query", "match_list", levenshtein_ratio("origin_query", "match_list").alias("match_score"))
        return out.where(F.col("match_score") >= least - 1e-9) if least > 0 else out
    return _blocked(q, c, groups, _known(scorer), least, best_of)


def _known(scorer: Scorer) -> Scorer:
    if scorer not in ("ratio", "levenshtein") and not callable(scorer):
        raise ValueError("scorer: ratio, levenshtein or a function")
    return scorer


def best(queries: DataFrame, choices: DataFrame, query_col: str, choice_col: str, groups: Sequence[str] = (), scorer: Scorer = "ratio", **options) -> DataFrame:
    """The best choice of each query; of equal scores the first by text."""
    return largest(queries, choices, query_col, choice_col, 1, groups, scorer, **options)


def largest(queries: DataFrame, choices: DataFrame, query_col: str, choice_col: str, k: int = 4, groups: Sequence[str] = (), scorer: Scorer = "ratio", **options) -> DataFrame:
    """The ``k`` best choices of each query; of equal scores the first by text. Blocks leave k rows a query each."""
    every = panel(queries, choices, query_col, choice_col, groups, scorer, best_of=k, **options)
    order = Window.partitionBy(*groups, "origin_query").orderBy(F.desc("match_score"), "match_list")
    return every.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def within(queries: DataFrame, choices: DataFrame, query_col: str, choice_col: str, threshold: float = 70.0, method: str = "greater_equal", groups: Sequence[str] = (), scorer: Scorer = "ratio", **options) -> DataFrame:
    """All pairs whose score passes the predicate; queries without one vanish. Lengths prune pairs for ``greater``, ``greater_equal``."""
    every = panel(queries, choices, query_col, choice_col, groups, scorer, max(threshold, 0.0) if method.startswith("greater") else 0.0, **options)
    return every.where(PREDICATES[method](F.col("match_score"), F.lit(float(threshold))))


def links(queries: DataFrame, choices: DataFrame, query_col: str, choice_col: str, threshold: float = 70.0, method: str = "greater_equal", groups: Sequence[str] = (), scorer: Scorer = "ratio", drop_first_group: bool = False) -> DataFrame:
    """``<groups>, origin_query, links BIGINT``: how many choices of each query ``within`` would give; queries without one vanish.

    All pairs are compared, but a block leaves a row a query, where ``within`` gives a row a pair.
    """
    groups, at = list(groups), float(threshold)
    q, c = _cleaned(queries, choices, query_col, choice_col, groups, drop_first_group)
    least = max(at, 0.0) if method.startswith("greater") else 0.0
    test = PREDICATES[method]
    every = _blocked(q, c, groups, _known(scorer), least, None, lambda value: test(value, at))
    return every.groupBy(*groups, "origin_query").agg(F.sum("links").alias("links"))


def pick_extremes(df: DataFrame, row: str, col: str, value: str, k: int, axis: int = 1, largest: bool = True) -> DataFrame:
    """``row, col, value, rank INT``: the ``k`` best of each row (axis 1) or column (axis 0); ties by position. NaN and null are the worst."""
    outer, inner = (row, col) if axis == 1 else (col, row)
    real = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    order = Window.partitionBy(outer).orderBy(F.desc(real), F.desc(value) if largest else F.asc(value), inner)
    return df.select(row, col, value, F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)


def pick_threshold(df: DataFrame, value: str, threshold: float, method: str = "greater_equal") -> DataFrame:
    """The cells that pass the predicate; NaN and null pass none. A filter: it reaches the scan."""
    passes: Column = PREDICATES[method](F.col(value), F.lit(threshold))
    return df.where(passes & ~F.isnan(F.col(value).cast("double")))


def unpivot_scores(df: DataFrame, row: str, columns: Sequence[str]) -> DataFrame:
    """``row, col, value`` of a wide score table."""
    return df.unpivot(row, list(columns), "col", "value")
