"""Operator 4: token counts by finite-state tokenizer compilation.

A byte-level BPE tokenizer is compiled into two deterministic transducers.

*Splitter.* Eleven states over ten classes of characters cut a text into pre-tokens. Each
transition says whether a pre-token begins at this character, and whether one began at the
one before (which is only known now). Texts are laid end to end and cut into chunks; each
chunk's map from every entry state to its exit state is computed for all chunks at once,
the maps compose through a parallel prefix scan, and a second pass from the right entry
states reads the output off.

*Merger.* Reading a pre-token byte by byte, the last token of the encoding of each prefix is
the one suffix token that is compatible with the last token before it. So a state needs no
more than, for each suffix that can still grow into a token, the token before that suffix and
the number of tokens since. Such states are made deterministic as they are met; a
transition carries the change of the token count that its byte causes. A pre-token
resets the state, so texts are cut into lanes at pre-tokens, and all lanes run at once. A
pre-token that is longer than a lane is cut inside: the map of such a part is worked out for the
states that the parts before it can end in, all parts at once, round by round until the
maps, composed through the same prefix scan, lead from the pre-token's start to its end.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quillon.llm._frames import pick, segment_sum, slices
from quillon.llm.bpe import VOCABULARY, Bpe, load_vocabulary

# classes of characters
LETTER, NUMBER, OTHER, SPACE, BLANK, QUOTE, STMD, RV, E, L, END = range(11)
# states of the splitter
START, IN_LETTERS, IN_NUMBER, IN_OTHER, ONE_SPACE, ONE_BLANK, RUN_SPACE, RUN_BLANK, AFTER_QUOTE, QUOTE_RV, QUOTE_L = range(11)
STATES = 11
CHUNK = 256
#: Bytes of a lane, about.
LANE = 1024
#: States of the merger that are kept; beyond them it begins anew with those that are in use, which changes no count.
MAX_STATES = 250_000
BOUNDARY = 0x110000
#: What the merger may still do: for each suffix that can grow, its node, the token before it and the tokens since.
State = tuple[tuple[int, int, int], ...]


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """The class of every code point, by the engine that splits texts elsewhere, and END for the mark between texts."""
    out = np.full(BOUNDARY + 1, OTHER, np.uint8)
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, sys.maxunicode + 1))))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
        out[np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), np.uint32)] = kind
    out[0x20], out[0x27], out[BOUNDARY] = SPACE, QUOTE, END
    for s, k in (("stmd", STMD), ("rv", RV), ("e", E), ("l", L)):
        for c in s:
            out[ord(c)] = k
    return out


@lru_cache(maxsize=1)
def splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, output) by state and class. Output: 1, a pre-token begins here; 2, one began at the character before."""
    letters = (LETTER, STMD, RV, E, L)
    move, out = np.zeros((STATES, 11), np.uint8), np.zeros((STATES, 11), np.uint8)

    def fresh(c: int) -> int:
        """The state after a class that begins a pre-token."""
        return IN_LETTERS if c in letters else {NUMBER: IN_NUMBER, OTHER: IN_OTHER, SPACE: ONE_SPACE, BLANK: ONE_BLANK, QUOTE: AFTER_QUOTE}[c]

    def joined(c: int) -> int:
        """The state after a class that continues what a space began."""
        return IN_OTHER if c == QUOTE else fresh(c)

    for s in range(STATES):
        for c in range(10):
            white = c in (SPACE, BLANK)
            to, o = fresh(c), 1
            if s == IN_LETTERS and c in letters or s == IN_NUMBER and c == NUMBER:
                to, o = s, 0
            elif s in (IN_OTHER, AFTER_QUOTE) and c in (OTHER, QUOTE):
                to, o = IN_OTHER, 0
            elif s == AFTER_QUOTE and c == STMD:
                to, o = START, 0
            elif s == AFTER_QUOTE and c in (RV, L):
                to, o = (QUOTE_RV if c == RV else QUOTE_L), 0
            elif s == QUOTE_RV and c == E or s == QUOTE_L and c == L:
                to, o = START, 0
            elif s in (QUOTE_RV, QUOTE_L):  # no contraction: the letter before began letters of its own
                to, o = (IN_LETTERS, 2) if c in letters else (fresh(c), 3)
            elif s in (ONE_SPACE, ONE_BLANK, RUN_SPACE, RUN_BLANK) and white:
                to, o = (RUN_SPACE if c == SPACE else RUN_BLANK), 0
            elif s == ONE_SPACE:
                to, o = joined(c), 0
            elif s == RUN_SPACE:
                to, o = joined(c), 2
            elif s == RUN_BLANK:
                to, o = fresh(c), 3
            move[s, c], out[s, c] = to, o
        out[s, END] = 2 if s in (QUOTE_RV, QUOTE_L) else 0
    return move, out


def compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Maps of states, one after the other."""
    return np.take_along_axis(then, first, axis=1)


def prefix_scan(maps: np.ndarray) -> np.ndarray:
    """The composition of each map with all before it, in log2(n) steps over all of them."""
    out, step = maps.copy(), 1
    while step < len(out):
        out[step:] = compose(out[:-step], out[step:])
        step *= 2
    return out


def pre_token_starts(points: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin, in code points of texts that BOUNDARY follows."""
    move, output = splitter()
    n = len(points)
    chunks = max(1, -(-n // CHUNK))
    symbol = np.full(chunks * CHUNK, END, np.intp)
    symbol[:n] = character_classes()[points]
    symbol = np.ascontiguousarray(symbol.reshape(chunks, CHUNK).T)
    table = move.astype(np.intp).ravel()
    state = np.tile(np.arange(STATES, dtype=np.intp), (chunks, 1))
    for k in range(CHUNK):
        state = table[state * 11 + symbol[k][:, None]]
    entry = np.r_[np.intp(START), prefix_scan(state)[:-1, START]]
    emitted = np.zeros((CHUNK, chunks), np.uint8)
    flat_out = output.ravel()
    for k in range(CHUNK):
        at = entry * 11 + symbol[k]
        emitted[k] = flat_out[at]
        entry = table[at]
    emitted = emitted.T.ravel()[:n]
    starts = (emitted & 1).astype(bool)
    starts[:-1] |= (emitted[1:] & 2).astype(bool)
    return starts


class Merger:
    """The merging transducer of a vocabulary, made deterministic as far as texts have needed it."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe
        self.rank = {(int(a), int(b)): (r, int(m)) for r, (a, b, m) in enumerate(zip(bpe.left, bpe.right, bpe.merged))}
        self.child: list[dict[int, int]] = [{}]
        self.token = [-1]
        for i, t in enumerate(bpe.by_id):
            node = 0
            for b in t:
                if b not in self.child[node]:
                    self.child[node][b] = len(self.child)
                    self.child.append({})
                    self.token.append(-1)
                node = self.child[node][b]
            if t:
                self.token[node] = i
        self.fits: dict[tuple[int, int], bool] = {}
        self.column = np.full(256, -1, np.int32)  # of each byte that texts have had
        self.width = 64
        self.forget(())

    def forget(self, kept: Iterable[int]) -> np.ndarray:
        """Begin anew with these states only; gives their new numbers."""
        keys = [self.states[x] for x in kept]
        start = ((0, -1, 0),)
        self.number, self.states = {start: 0}, [start]
        self.next = np.full((1024, self.width), -1, np.int32)
        self.delta = np.zeros((1024, self.width), np.int8)
        return np.array([self.numbered(k) for k in keys], np.int64)

    def numbered(self, key: State) -> int:
        """The number of a state, a new one where it is new."""
        to = self.number.setdefault(key, len(self.states))
        if to == len(self.states):
            self.states.append(key)
            if to >= len(self.next):
                self.next = np.concatenate([self.next, np.full_like(self.next, -1)])
                self.delta = np.concatenate([self.delta, np.zeros_like(self.delta)])
        return to

    def columns(self, data: np.ndarray) -> np.ndarray:
        """The table's column for each byte; bytes that are new get one."""
        fresh = [b for b in np.flatnonzero(np.bincount(data, minlength=256)) if self.column[b] < 0]
        used = int(self.column.max()) + 1
        self.column[fresh] = np.arange(used, used + len(fresh))
        while used + len(fresh) > self.width:
            self.width += 32
            self.next = np.concatenate([self.next, np.full((len(self.next), 32), -1, np.int32)], 1)
            self.delta = np.concatenate([self.delta, np.zeros((len(self.delta), 32), np.int8)], 1)
        return self.column[data]

    def compatible(self, before: int, token: int) -> bool:
        """Whether the encoding of the two tokens' bytes is these two tokens (-1: the token stands alone)."""
        key = (before, token)
        if key not in self.fits:
            by_id, ids = self.bpe.by_id, self.bpe.byte_ids
            own = [int(ids[b]) for b in (by_id[before] if before >= 0 else b"") + by_id[token]]
            while len(own) > 1:
                best = min(((self.rank[p], i) for i in range(len(own) - 1) if (p := (own[i], own[i + 1])) in self.rank), default=None)
                if best is None:
                    break
                own[best[1] : best[1] + 2] = [best[0][1]]
            self.fits[key] = own == ([token] if before < 0 else [before, token])
        return self.fits[key]

    def extend(self, state: int, byte: int) -> None:
        """Work out one transition."""
        grown, last, change = [], None, 0
        for node, before, since in self.states[state]:
            to = self.child[node].get(byte)
            if to is None:
                continue
            token = self.token[to]
            if last is None and token >= 0 and self.compatible(before, token):
                last, change = token, 1 - since
            if self.child[to]:
                grown.append((to, before, since))
        to = self.numbered((*((n, b, s + change) for n, b, s in grown), (0, last, 0)))
        self.next[state, self.column[byte]], self.delta[state, self.column[byte]] = to, change

    def walk(self, data: np.ndarray, symbol: np.ndarray, begin: np.ndarray, stop: np.ndarray, state: np.ndarray, starts: np.ndarray | None = None, out: np.ndarray | None = None) -> tuple[list[State], np.ndarray]:
        """(state, change of the token count) at the end of each lane that is entered in ``state``; ``out`` gets the change at every byte."""
        order = np.argsort(begin - stop, kind="stable")  # the longest first: lanes that are done fall off the end
        begin, length, state = begin[order], (stop - begin)[order], state[order].astype(np.int64)
        total = np.zeros(len(begin), np.int64)
        live = len(begin)
        for k in range(int(length[0]) if live else 0):
            while length[live - 1] <= k:
                live -= 1
            at = begin[:live] + k
            byte = symbol[at]
            now = state[:live] if starts is None else np.where(starts[at], 0, state[:live])
            to = self.next[now, byte]
            if (unknown := to < 0).any():
                if len(self.states) > MAX_STATES:
                    used, place = np.unique(np.r_[now, state], return_inverse=True)
                    place = self.forget(used.tolist())[place]
                    now, state = place[:live], place[live:]
                    unknown = np.ones(live, bool)
                for s, b in {(int(s), int(b)) for s, b in zip(now[unknown], data[at[unknown]])}:
                    if self.next[s, self.column[b]] < 0:
                        self.extend(s, b)
                to = self.next[now, byte]
            change = self.delta[now, byte]
            total[:live] += change
            if out is not None:
                out[at] = change
            state[:live] = to
        back = np.argsort(order)
        return [self.states[x] for x in state[back].tolist()], total[back]

    def count(self, data: np.ndarray, starts: np.ndarray, lane: int | None = None) -> np.ndarray:
        """The change of the token count at every byte, or all of it at the first byte of a part of a long pre-token.

        ``starts`` says where pre-tokens begin (the first byte does).
        """
        lane = lane or LANE
        n = len(data)
        symbol = self.columns(data)
        out = np.zeros(n, np.int64)
        first = np.flatnonzero(starts)
        if not len(first):
            return out
        ends = np.r_[first[1:], n]
        # a lane begins at the first pre-token of each chunk, and behind a long pre-token
        at = np.searchsorted(first, np.arange(0, n, lane))
        long = np.flatnonzero(ends - first > 2 * lane)
        begin = first[np.unique(np.r_[at[at < len(first)], long, long[long + 1 < len(first)] + 1])]
        stop = np.r_[begin[1:], n]
        cut = np.minimum(stop, np.where(np.isin(begin, first[long]), begin + lane, n))
        exits, _ = self.walk(data, symbol, begin, cut, np.zeros(len(begin), np.int64), starts, out)
        for b, c, s, state in zip(begin.tolist(), cut.tolist(), stop.tolist(), exits):
            if c < s:
                part = np.arange(c, s, lane)
                out[part] = self.parts(data, symbol, part, np.minimum(part + lane, s), state)
        return out

    def parts(self, data: np.ndarray, symbol: np.ndarray, begin: np.ndarray, stop: np.ndarray, state: State) -> np.ndarray:
        """The change of the token count in each of the parts of one pre-token, the first of which is entered in ``state``."""
        n = len(begin)
        kind: dict[bytes, int] = {}  # parts of one content have one map
        of = np.array([kind.setdefault(data[a:b].tobytes(), len(kind)) for a, b in zip(begin, stop)])
        known: list[dict[State, tuple[State, int]]] = [{} for _ in kind]
        where = np.unique(of, return_index=True)[1]
        asked = {(int(of[0]), state), *((int(k), self.states[0]) for k in of[1:])}
        while True:
            todo = [(k, s) for k, s in asked if s not in known[k]]
            if todo:
                at = where[[k for k, _ in todo]]
                exits, change = self.walk(data, symbol, begin[at], stop[at], np.array([self.numbered(s) for _, s in todo]))
                for (k, s), e, c in zip(todo, exits, change.tolist()):
                    known[k][s] = (e, c)
            entries = [list(m) for m in known]
            width = max(map(len, entries)) + 1  # the last column: not known yet
            place = [{s: i for i, s in enumerate(x)} for x in entries]
            maps = np.full((n, width), width - 1)
            for i in range(n - 1):
                for j, s in enumerate(entries[of[i]]):
                    maps[i, j] = place[of[i + 1]].get(known[of[i]][s][0], width - 1)
            begun = place[of[0]][state]
            at = np.r_[begun, prefix_scan(maps)[:-1, begun]]
            if (at < width - 1).all():
                return np.array([known[k][entries[k][j]][1] for k, j in zip(of, at)])
            asked = {(int(of[i]), known[of[i - 1]][s][0]) for i in range(1, n) if at[i] == width - 1 for s in entries[of[i - 1]]}


#: By vocabulary: a Python worker keeps the states it has met from task to task.
_MERGERS: dict[str, Merger] = {}


def count_texts(merger: Merger, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, pre-tokens) of each text."""
    points, sizes = [], []
    mark = np.array([BOUNDARY], np.uint32)
    for t in texts:
        own = np.frombuffer(t.encode("utf-32-le"), np.uint32)
        points += (own, mark)
        sizes.append(len(own) + 1)
    flat = np.concatenate(points) if points else np.zeros(0, np.uint32)
    offsets = np.r_[0, np.cumsum(sizes)].astype(np.int64)
    starts = pre_token_starts(flat)
    pre = segment_sum(starts.astype(np.int64), offsets)
    real = flat != BOUNDARY
    width = (1 + (flat > 0x7F).astype(np.int64) + (flat > 0x7FF) + (flat > 0xFFFF)) * real
    ends = np.cumsum(width)
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.zeros(len(data), bool)
    at[(ends - width)[starts]] = True
    change = merger.count(data, at)
    return segment_sum(change, np.r_[0, ends][offsets]), pre


def count(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_tokens INT, n_pre_tokens INT`` for every row, as the tokenizer's own encoding counts them.

    A null text has null counts, an empty one 0. Repeated rows give repeated results; a null
    id stays null; other columns are dropped. One Arrow pass over whole texts, no shuffle.
    """
    tables = df.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))
    narrow = pick(df, doc_id=id_col, text=text_col)
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = _MERGERS.get(vocabulary)
        if merger is None:
            _MERGERS.clear()
            merger = _MERGERS[vocabulary] = Merger(tables.value)
        for batch in slices(batches, limit=4 << 20):
            texts = batch.column("text")
            missing = texts.is_null().to_numpy(zero_copy_only=False)
            tokens, pre = count_texts(merger, [t or "" for t in texts.to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(tokens.astype(np.int32), mask=missing), pa.array(pre.astype(np.int32), mask=missing)], ["doc_id", "n_tokens", "n_pre_tokens"])

    return narrow.mapInArrow(run, f"doc_id {kind}, n_tokens int, n_pre_tokens int")
