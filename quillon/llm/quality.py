"""Operator 6: quality classifier, a sparse rule ensemble.

Statistics of a text are built-in Spark expressions. On a bounded sample of labelled rows,
small boosted trees propose conjunctive rules (the path to each of their nodes); lasso
logistic regression keeps few of them and weighs them; the rules that are left compile
into one Spark column, so that scoring is a projection without Python.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import let
from quillon.llm._frames import pick

#: A condition: (statistic, True for "at most" or False for "more than", threshold).
Condition = tuple[str, bool, float]


def statistics(text: Column) -> Column:
    """A struct of the statistics by name; each is 0 for an empty text. Words and lines are split once."""
    t = F.coalesce(text, F.lit(""))
    base = F.struct(t.alias("t"), pieces(F.translate(t, "\n\t\r\x0b\x0c", "     "), " ").alias("words"), pieces(t, "\n").alias("lines"))

    def of(v: Column) -> Column:
        t, words, lines = v["t"], v["words"], v["lines"]
        chars = F.greatest(F.length(t), F.lit(1))
        n, m = F.greatest(F.size(words), F.lit(1)), F.greatest(F.size(lines), F.lit(1))
        again = F.filter(F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(1))), lambda a, b: a == b), lambda x: x)
        only = lambda other: F.length(F.regexp_replace(t, other, "")) / chars
        without = lambda signs: (F.length(t) - F.length(F.translate(t, signs, ""))) / chars
        values = (
            F.size(words).cast("double"),
            (F.length(t) / n).cast("double"),
            only(r"\P{Lu}+"),
            only(r"\P{L}+"),
            without("!?"),
            without(r"#$%&*|<>^~=_{}\[]"),
            F.size(F.array_distinct(words)) / n,
            F.size(F.array_distinct(lines)) / m,
            F.size(again) / n,
        )
        return F.struct(*[v.alias(name) for name, v in zip(STATISTICS, values)])

    return let(base, of)


def pieces(text: Column, sep: str) -> Column:
    return F.filter(F.split(text, sep), lambda w: w != "")


STATISTICS = ("words", "word_length", "upper", "letters", "exclaim", "symbols", "distinct_words", "distinct_lines", "repeats")


@dataclass
class RuleModel:
    intercept: float
    rules: list[tuple[tuple[Condition, ...], float]] = field(default_factory=list)

    def score(self, columns: dict[str, Column]) -> Column:
        """Probability of good quality as one expression over the statistics."""
        total = F.lit(float(self.intercept))
        for conditions, weight in self.rules:
            hit = F.lit(True)
            for name, low, at in conditions:
                hit = hit & ((columns[name] <= at) if low else (columns[name] > at))
            total = total + F.when(hit, F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for conditions, weight in self.rules:
            z += weight * _holds(x, conditions)
        return 1 / (1 + np.exp(-z))


def _holds(x: np.ndarray, conditions: tuple[Condition, ...]) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for name, low, at in conditions:
        v = x[:, STATISTICS.index(name)]
        hit &= (v <= at) if low else (v > at)
    return hit


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, path: tuple[Condition, ...], depth: int, cuts: list[np.ndarray], rules: dict, out: np.ndarray, rate: float) -> None:
    """One tree of second-order boosting; every node but the root adds the rule of its path."""
    gs, hs = g[rows].sum(), h[rows].sum()
    best = (1e-6, -1, 0.0)
    if depth:
        for k, at in enumerate(cuts):
            if not len(at):
                continue
            place = np.searchsorted(at, x[rows, k], side="left")
            gl = np.cumsum(np.bincount(place, g[rows], len(at) + 1))[:-1]
            hl = np.cumsum(np.bincount(place, h[rows], len(at) + 1))[:-1]
            nl = np.cumsum(np.bincount(place, minlength=len(at) + 1))[:-1]
            gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
            gain[(nl < 5) | (len(rows) - nl < 5)] = -1
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (float(gain[i]), k, float(at[i]))
    if best[1] < 0:
        out[rows] += rate * gs / (hs + 1)
        return
    _, k, at = best
    for low in (True, False):
        side = rows[(x[rows, k] <= at) == low]
        more = (*path, (STATISTICS[k], low, at))
        rules.setdefault(tuple(sorted(more)), None)
        _grow(x, g, h, side, more, depth - 1, cuts, rules, out, rate)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, penalty: float = 0.002, steps: int = 400, seed: int = 7) -> RuleModel:
    """Rules of boosted trees under lasso logistic weights. With one class only, or too few rows, the model keeps everything."""
    if not len(y) or y.min() == y.max():
        return RuleModel(10.0)
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.round(np.quantile(x[:, k], np.linspace(0.01, 0.99, 64)), 6)) for k in range(x.shape[1])]
    rules: dict[tuple[Condition, ...], None] = {}
    z = np.zeros(len(y))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        rows = np.flatnonzero(rng.random(len(y)) < 0.7)
        step = np.zeros(len(y))
        _grow(x, y - p, p * (1 - p), rows, (), depth, cuts, rules, step, 0.3)
        z += step
    names = list(rules)
    if not names:  # too few rows for any split
        return RuleModel(10.0)
    m = np.stack([_holds(x, r) for r in names], 1).astype(np.float64)
    used = (m.mean(0) > 0.001) & (m.mean(0) < 0.999)
    names, m = [r for r, u in zip(names, used) if u], m[:, used]
    # equal classes: else the rarer, the rejected, would count for little
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    a = np.c_[m, np.ones(len(y))]
    lip = 0.25 * np.linalg.norm(a * np.sqrt(weight)[:, None], 2) ** 2
    w = v = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(steps):  # accelerated proximal gradient
        p = 1 / (1 + np.exp(-a @ v))
        u = v - a.T @ (weight * (p - y)) / lip
        u[:-1] = np.sign(u[:-1]) * np.maximum(np.abs(u[:-1]) - penalty / lip, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = u + (t - 1) / t2 * (u - w), u, t2
    kept = [(r, float(c)) for r, c in zip(names, w[:-1]) if abs(c) > 1e-4]
    return RuleModel(float(w[-1]), kept)


def train(documents: DataFrame, labels: DataFrame, max_labelled: int = 20_000, **options) -> RuleModel:
    """Fit on at most ``max_labelled`` labelled rows, those of least hash; rows with a null label or id are left out.

    Of repeated labels the lower one counts, of repeated ids the text of least statistics. Without labels, or
    with those of one class only, everything with words is kept.
    """
    own = pick(labels, doc_id="doc_id", quality="quality").dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    docs = pick(documents, doc_id="doc_id", text="text").join(F.broadcast(own), "doc_id")  # at most max_labelled rows of two numbers
    rows = docs.select("doc_id", "quality", statistics(F.col("text")).alias("s")).groupBy("doc_id", "quality").agg(F.min("s").alias("s"))
    rows = rows.select("doc_id", "quality", "s.*").toPandas().sort_values("doc_id")
    return fit(rows[list(STATISTICS)].to_numpy(np.float64), (rows["quality"].to_numpy() > 0).astype(np.float64), **options)


def score(df: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``doc_id, quality_score DOUBLE, keep BOOLEAN`` for every row.

    A text that is null, empty or white space scores 0 and isn't kept; one of any length is looked at
    whole. Repeated rows get equal results; a null id stays null; other columns are dropped; an empty table
    gives an empty result. No shuffle and no Python.
    """
    value = judged(F.col("text"), model)
    return pick(df, doc_id=id_col, text=text_col).select("doc_id", value.alias("quality_score")).withColumn("keep", F.col("quality_score") >= threshold)


def judged(text: Column, model: RuleModel) -> Column:
    """The score of a text, 0 for one without words.

    The statistics are worked out once and bound to a name: rules name them many times, and a filter on
    the score would else be pushed below them with a copy of each for each time.
    """
    return let(statistics(text), lambda s: F.when(s["words"] == 0, F.lit(0.0)).otherwise(F.round(model.score({n: s[n] for n in STATISTICS}), 6)))


def keep_good(documents: DataFrame, model: RuleModel, threshold: float = 0.5) -> DataFrame:
    """The documents that ``score`` keeps, by the same rules; all columns, row by row.

    A text that is null, empty or blank goes at any threshold above 0; nulls in other columns don't matter. Repeated
    rows stay or go together; a score at the threshold stays; an empty table stays empty.
    """
    flat = documents.toDF(*[f"_c{i}" for i in range(len(documents.columns))])
    text = F.col(f"_c{documents.columns.index('text')}")
    return flat.where(judged(text, model) >= F.lit(float(threshold))).toDF(*documents.columns)
