"""String similarity: indel ratio by bit-parallel longest common subsequence, vectorised over pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

_WORD = 64


class Choices:
    """Strings as a matrix of character codes, the shortest first, so that a column's live rows are a suffix."""

    def __init__(self, strings: list[str]):
        size = np.fromiter(map(len, strings), np.int64, len(strings))
        self.order = np.argsort(size, kind="stable")
        self.size = size[self.order]
        self.letters = {c: i for i, c in enumerate(sorted(set("".join(strings))))}
        width = int(size.max()) if len(strings) else 0
        self.codes = np.zeros((width, len(strings)), np.int32)
        for row, i in enumerate(self.order):
            self.codes[: size[i], row] = [self.letters[c] for c in strings[i]]
        self.live = np.searchsorted(self.size, np.arange(width), side="right")

    def ratios(self, query: str, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """(choice, ratio) of those whose lengths allow a ratio of ``least``: 200 * LCS / (sum of lengths); two empty strings: 100."""
        m = len(query)
        # LCS is at most the lesser length
        low, high = (m * least / (200 - least), m * (200 - least) / least) if least > 0 else (0, np.inf)
        a, b = np.searchsorted(self.size, low - 1e-9, "left"), np.searchsorted(self.size, high + 1e-9, "right")
        total = (self.size[a:b] + m).astype(np.float64)
        lcs = np.zeros(b - a, np.int64)
        # a query longer than a machine word is cut into words; the addition carries from one to the next
        words = max(1, -(-m // _WORD))
        masks = np.zeros((words, len(self.letters) + 1), np.uint64)
        for i, c in enumerate(query):
            if c in self.letters:
                masks[i // _WORD, self.letters[c]] |= np.uint64(1 << (i % _WORD))
        if b > a and m:
            state = np.full((words, b - a), ~np.uint64(0))
            width = int(self.size[b - 1])
            with np.errstate(over="ignore"):
                for j in range(width):
                    at = max(int(self.live[j]) - a, 0)
                    code = self.codes[j, a + at : b]
                    carry = None
                    for w in range(words):
                        v = state[w, at:]
                        u = v & masks[w][code]
                        s = v + u
                        over = s < v if words > 1 else None
                        if carry is not None:
                            s2 = s + carry
                            over |= s2 < s
                            s = s2
                        state[w, at:] = s | (v - u)
                        carry = over.astype(np.uint64) if words > 1 else None
            for w in range(words):
                lcs += np.bitwise_count(~state[w] & np.uint64((1 << min(_WORD, m - w * _WORD)) - 1)).astype(np.int64)
        ratio = np.where(total > 0, 200.0 * lcs / np.maximum(total, 1), 100.0)
        return self.order[a:b], ratio

    def distances(self, query: str) -> np.ndarray:
        """The edit distance to each choice, in the order of ``self.order``: a column of letters at a time, the query's places as bits."""
        m, n = len(query), len(self.size)
        if m == 0 or n == 0:
            return self.size.copy()
        if m > _WORD:
            return self._long_distances(query)
        kind = np.uint32 if m <= 32 else np.uint64
        masks, out = np.zeros(len(self.letters) + 1, kind), np.full(n, m, np.int32)
        for i, c in enumerate(query):
            if c in self.letters:
                masks[self.letters[c]] |= kind(1 << i)
        top, one = kind(m - 1), kind(1)
        up, down = np.full(n, ~kind(0)), np.zeros(n, kind)
        with np.errstate(over="ignore"):
            for j in range(len(self.codes)):
                at = int(self.live[j])
                eq, p, d = masks[self.codes[j, at:]], up[at:], down[at:]
                v = eq | d
                h = (((eq & p) + p) ^ p) | eq
                plus, minus = d | ~(h | p), p & h
                out[at:] += ((plus >> top) & one).astype(np.int32) - ((minus >> top) & one).astype(np.int32)
                plus = (plus << one) | one
                up[at:] = (minus << one) | ~(v | plus)
                down[at:] = plus & v
        return out

    def _long_distances(self, query: str) -> np.ndarray:
        """The same for a query longer than a machine word: row by row of the table of prefixes."""
        width, n = self.codes.shape
        row = np.repeat(np.arange(width + 1)[:, None], n, 1)
        for i, c in enumerate(query, 1):
            code, new = self.letters.get(c, -1), np.empty_like(row)
            new[0] = i
            for j in range(width):
                new[j + 1] = np.minimum(np.minimum(row[j + 1], new[j]) + 1, row[j] + (self.codes[j] != code))
            row = new
        return row[self.size, np.arange(n)]

    def levenshtein_ratios(self, query: str) -> tuple[np.ndarray, np.ndarray]:
        """(choice, ratio): 100 * (1 - distance / greater length); two empty strings: 100."""
        most = np.maximum(self.size, len(query))
        return self.order, np.where(most > 0, 100.0 * (1 - self.distances(query) / np.maximum(most, 1)), 100.0)


class _Trie:
    """Strings of one length ``n``, in order, as a trie: of each level the letters of its nodes, and the first child of each on the next one."""

    def __init__(self, codes: np.ndarray, rows: np.ndarray):
        self.rows, (count, self.n) = rows, codes.shape
        same = np.full(count, -1)  # letters that a string begins with like the one before it
        if count > 1:
            differs = codes[1:] != codes[:-1]
            same[1:] = np.where(differs.any(1), differs.argmax(1), self.n) if self.n else self.n
        self.letters, self.first, at = [None], [], np.array([0])
        for d in range(1, self.n + 1):
            new = same < d
            below = np.flatnonzero(new)
            self.first.append(np.append(np.searchsorted(below, at), len(below)))
            self.letters.append(codes[below, d - 1])
            at = below


class Tries:
    """Distinct strings, in order, as a trie for each length: the nearest ones of many queries at once, branches that can't hold any left out.

    Of a query the last column of the table of the longest common subsequence is kept at each node, as bits. With r letters
    to come it can grow by no more than r, so a branch is left where that is too little. Nothing is approximate: a query
    for which too much of the tries is left has to be compared with all strings instead.
    """

    #: Longest query and string, in letters; nodes that are gone on from at once, and queries at most.
    MOST, NODES, QUERIES = _WORD, 1 << 14, 1 << 13

    def __init__(self, strings: list[str]):
        size = np.fromiter(map(len, strings), np.int64, len(strings))
        points = {int(n): np.array([strings[i] for i in np.flatnonzero(size == n)], f"U{max(n, 1)}").view(np.uint32).reshape(-1, max(n, 1))[:, :n] for n in np.unique(size)}
        self.known = np.unique(np.concatenate([np.unique(x) for x in points.values()])) if points else np.zeros(0, np.uint32)
        kind = np.min_scalar_type(len(self.known))
        self.tries = [_Trie(np.searchsorted(self.known, x).astype(kind), np.flatnonzero(size == n)) for n, x in points.items()]
        #: Children looked at for a query before all strings are compared instead, which takes about as long.
        self.limit = 4096 + len(strings)

    def nearest(self, queries: list[str], least: float, k: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, string, ratio) of all pairs of at least ``least``, or of each query's ``k`` best, of equal ones the first; and the queries that were given up."""
        size = np.fromiter(map(len, queries), np.int64, len(queries))
        step = max(1, min(self.QUERIES, (self.NODES << 8) // (len(self.known) + 1)))
        parts, given_up = [], [np.flatnonzero(size > self.MOST)]
        for m in np.unique(size[size <= self.MOST]):
            every = np.flatnonzero(size == m)
            for first in range(0, len(every), step):
                rows = every[first : first + step]
                own, at, value, left = self._batch([queries[i] for i in rows], int(m), least, k)
                parts.append((rows[own], at, value))
                given_up.append(rows[left])
        own, at, value = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return own, at, value, np.concatenate(given_up)

    def _batch(self, queries: list[str], m: int, least: float, k: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        kind, width = (np.uint32 if m <= 32 else np.uint64), len(self.known) + 1
        masks = np.zeros((len(queries), width), kind)
        if m and width > 1:
            points = np.array(queries, f"U{m}").view(np.uint32).reshape(-1, m)
            codes = np.minimum(np.searchsorted(self.known, points), width - 2)
            codes[self.known[codes] != points] = width - 1
            for i in range(m):
                masks[np.arange(len(queries)), codes[:, i]] |= kind(1 << i)
        masks[:, width - 1] = 0
        spent, bound = np.zeros(len(queries), np.int64), np.full(len(queries), least - 1e-9 if least > 0 else -1.0)
        own, at, value = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        # the lengths that can be nearest come first, so that the others are soon out of reach
        for trie in sorted(self.tries, key=lambda t: -min(m, t.n) / max(m + t.n, 1)):
            total, most = m + trie.n, min(m, trie.n)
            ratio = 200.0 * np.arange(most + 1) / total if total else np.array([100.0])
            lowest = np.searchsorted(ratio, bound)
            if k is None:
                found = [self._descend(trie, masks, m, np.arange(len(queries)), int(lowest[0]), None, spent)] if lowest[0] <= most else []
            else:
                found, left = [], np.full(len(queries), k)
                for need in range(most, int(lowest.min()) - 1, -1):
                    alive = np.flatnonzero((lowest <= need) & (left > 0) & (spent <= self.limit))
                    if len(alive):
                        found.append(self._descend(trie, masks, m, alive, need, left, spent))
            if not found:
                continue
            own, at = (np.concatenate([a, *(x[j] for x in found)]) for j, a in enumerate((own, at)))
            value = np.concatenate([value, *(ratio[x[2]] for x in found)])
            order = np.lexsort((at, -value, own))
            own, at, value = own[order], at[order], value[order]
            if k is not None:
                rank = rank_in(own)
                own, at, value, rank = (x[rank < k] for x in (own, at, value, rank))
                bound[own[rank == k - 1]] = value[rank == k - 1]
        keep = spent[own] <= self.limit
        return own[keep], at[keep], value[keep], np.flatnonzero(spent > self.limit)

    def _descend(self, trie: _Trie, masks: np.ndarray, m: int, queries: np.ndarray, need: int, left: np.ndarray | None, spent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, string, length of the subsequence) where it is at least ``need``; with ``left`` just ``need``, and of each query the first ``left``, of which they are taken.

        What is not gone on from yet waits at its level; the deepest goes on first, and of it each query's first nodes,
        so strings are met in order.
        """
        n, kind, flat, width = trie.n, masks.dtype.type, masks.ravel(), masks.shape[1]
        if n == 0:
            queries = queries if need == 0 else queries[:0]
            if left is not None:
                left[queries] -= 1
            return queries, np.full(len(queries), trie.rows[0]), np.zeros(len(queries), np.int64)
        waiting: list = [None] * n
        waiting[0] = (queries, np.zeros(len(queries), np.int64), np.full(len(queries), ~kind(0)))
        out, d = [(np.zeros(0, np.int64),) * 3], 0
        while d >= 0:
            if waiting[d] is None:
                d -= 1
                continue
            q, node, state = waiting[d]
            alive = spent[q] <= self.limit
            if left is not None:
                alive &= left[q] > 0
            if not alive.all():
                q, node, state = q[alive], node[alive], state[alive]
            waiting[d] = None
            if not len(q):
                continue
            begin = trie.first[d][node]
            count = trie.first[d][node + 1] - begin
            go = np.cumsum(count) <= self.NODES << 4
            go[0] = True
            if len(q) > self.NODES and left is not None:
                rank = rank_in(q)
                go &= rank < max(1, self.NODES // int((rank == 0).sum()))
            elif len(q) > self.NODES:
                go[self.NODES :] = False
            if not go.all():
                waiting[d] = (q[~go], node[~go], state[~go])
                q, state, begin, count = q[go], state[go], begin[go], count[go]
            spent += np.bincount(q, count, len(spent)).astype(np.int64)
            ends = np.cumsum(count)
            child = np.arange(ends[-1]) + np.repeat(begin - ends + count, count)
            q, state = np.repeat(q, count), np.repeat(state, count)
            met = state & flat[q * width + trie.letters[d + 1][child]]
            with np.errstate(over="ignore"):
                state = (state + met) | (state - met)
            rest = n - d - 1
            length = np.bitwise_count(~state & kind((1 << max(m - rest, 0)) - 1))
            if rest:
                keep = np.flatnonzero(length >= need - min(rest, m)) if need > min(rest, m) else slice(None)
                waiting[d + 1] = (q[keep], child[keep], state[keep])
                d += 1
                continue
            keep = np.flatnonzero(length >= need if left is None else length == need)
            q, child, length = q[keep], child[keep], length[keep].astype(np.int64)
            if left is not None and len(q):
                keep = rank_in(q) < left[q]
                q, child, length = q[keep], child[keep], length[keep]
                left -= np.bincount(q, minlength=len(left))
            out.append((q, trie.rows[child], length))
        return tuple(np.concatenate(x) for x in zip(*out))


def rank_in(groups: np.ndarray) -> np.ndarray:
    """The place of each value among its equals, which are neighbours."""
    first = np.flatnonzero(np.append(True, groups[1:] != groups[:-1])) if len(groups) else np.zeros(0, np.int64)
    return np.arange(len(groups)) - np.repeat(first, np.diff(np.append(first, len(groups))))


def indel_ratio(left: str, right: str) -> float:
    return float(Choices([right]).ratios(left)[1][0])


def indel_ratio_column(left: Column | str, right: Column | str) -> Column:
    """The indel ratio of two columns, 0 to 100; null if either is null."""

    @pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, index=a.index, dtype="float64").astype(object)
        for q, rows in a.groupby(a).groups.items():
            own = b.loc[rows].dropna()
            if len(own):
                at, ratio = Choices(own.tolist()).ratios(q)
                back = np.empty(len(own))
                back[at] = ratio
                out.loc[own.index] = back
        return out.where(out.notna(), None)

    return score(left, right)


def levenshtein_ratio(left: Column | str, right: Column | str) -> Column:
    """100 * (1 - distance / greater length), in the JVM; two empty strings: 100."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (left, right))
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most == 0, 100.0).otherwise(100.0 * (1 - F.levenshtein(a, b) / most))
