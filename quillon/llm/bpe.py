"""Operator 1: byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

All distinct pre-tokens of a batch are merged together. The queue has one bucket for each
merge rank; a bucket holds positions in the linked list of symbols. A three-level bitmap
marks the buckets that aren't empty, so find-first-set gives the next rank in three steps,
whatever the length of a pre-token. Entries are never removed when a neighbour's merge
makes them wrong: they are recognised as stale, and skipped, when their bucket comes up.
The positions of one bucket are merged by one vectorised step, which is the leftmost-first
order of the algorithm: within a run of overlapping pairs every second one counts.
"""

from __future__ import annotations

import base64
import json
import re
import sys
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from quillon.llm._frames import pick, repeat_ranges, slices

#: Splits a text into pre-tokens, which are merged independently (the public pattern of the rank files).
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The same by the standard library's faster engine, right for texts without a character of ``unlike()``.
_QUICK = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
_SHIFT = 24


class Bpe:
    """Tables of a byte-level BPE vocabulary: bytes of each id, and the merges in order of rank."""

    def __init__(self, tokens: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.ids = tokens
        size = max(tokens.values()) + 1
        by_id = [b""] * size
        for t, i in tokens.items():
            by_id[i] = t
        self.by_id = by_id
        self.byte_ids = np.array([tokens[bytes([b])] for b in range(256)], np.int32)
        self.left = np.array([tokens[a] for a, _ in merges], np.int64)
        self.right = np.array([tokens[b] for _, b in merges], np.int64)
        self.merged = np.array([tokens[a + b] for a, b in merges], np.int32)
        keys = self.left << _SHIFT | self.right
        order = np.argsort(keys, kind="stable")
        self.keys, self.key_ranks = keys[order], order.astype(np.int32)
        length = np.array([len(t) for t in by_id], np.int64)
        self.token_offsets = np.r_[0, np.cumsum(length)]
        self.token_bytes = np.frombuffer(b"".join(by_id), np.uint8)
        pair = np.arange(65536)
        self.byte_pair_ranks = self.ranks(self.byte_ids[pair >> 8], self.byte_ids[pair & 255])

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it isn't merged."""
        keys = left.astype(np.int64) << _SHIFT | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.key_ranks[at], -1)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after another, offsets of each piece's ids)."""
        buf = np.frombuffer(b"".join(pieces), np.uint8)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(lengths)
        n = len(buf)
        if not n:
            return np.zeros(0, np.int32), np.r_[0, ends]
        sym = self.byte_ids[buf]
        following = np.arange(1, n + 1)
        following[ends[lengths > 0] - 1] = -1
        before = np.arange(-1, n - 1)
        before[(ends - lengths)[lengths > 0]] = -1
        queue = RankQueue(len(self.merged))
        first = np.flatnonzero(following >= 0)
        queue.push(self.byte_pair_ranks[buf[first].astype(np.int32) << 8 | buf[first + 1]], first)
        while (r := queue.first()) >= 0:
            at = queue.take(r)
            left, right = self.left[r], self.right[r]
            then = following[at]
            fresh = (sym[at] == left) & (then >= 0)
            fresh &= sym[then] == right  # at -1 too: masked above
            at = at[fresh]
            if not len(at):
                continue
            if left == right:
                at.sort()
                starts = np.r_[True, following[at[:-1]] != at[1:]]
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(starts, place, 0))) % 2 == 0]
            gone = following[at]
            sym[at], sym[gone] = self.merged[r], -1
            then = following[gone]
            following[at] = then
            has = then >= 0
            before[then[has]] = at[has]
            a = at[has]
            back = before[at]
            b = back[back >= 0]
            b = b[sym[b] != self.merged[r]]  # a pair of two new symbols is already in a
            pairs = np.concatenate([a, b])
            if len(pairs):
                queue.push(self.ranks(sym[pairs], sym[following[pairs]]), pairs)
        alive = sym >= 0
        return sym[alive], np.r_[0, np.cumsum(alive)][np.r_[0, ends]]

    def decode_bytes(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all lists of ids, offsets of each list's bytes)."""
        lengths = self.token_offsets[ids + 1] - self.token_offsets[ids]
        return self.token_bytes[repeat_ranges(self.token_offsets[ids], lengths)], np.r_[0, np.cumsum(lengths)][offsets]


class RankQueue:
    """Buckets of positions by rank under a bitmap of 64 x 64 x 64 ranks (more: the top word grows)."""

    def __init__(self, ranks: int):
        self.low = [0] * (ranks // 64 + 1)
        self.mid = [0] * (ranks // 4096 + 1)
        self.top = 0
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        good = ranks >= 0
        ranks, positions = ranks[good], positions[good]
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        starts = [0, *cuts.tolist()] if len(ranks) else []
        ends = [*cuts.tolist(), len(ranks)]
        for r, a, b in zip(ranks[starts].tolist() if starts else [], starts, ends):
            if r in self.buckets:
                self.buckets[r].append(positions[a:b])
                continue
            self.buckets[r] = [positions[a:b]]
            self.low[r >> 6] |= 1 << (r & 63)
            self.mid[r >> 12] |= 1 << (r >> 6 & 63)
            self.top |= 1 << (r >> 12)

    def first(self) -> int:
        """The lowest rank with a bucket, -1 if there is none."""
        if not self.top:
            return -1
        a = (self.top & -self.top).bit_length() - 1
        w = self.mid[a]
        b = a << 6 | (w & -w).bit_length() - 1
        w = self.low[b]
        return b << 6 | (w & -w).bit_length() - 1

    def take(self, r: int) -> np.ndarray:
        parts = self.buckets.pop(r)
        self.low[r >> 6] &= ~(1 << (r & 63))
        if not self.low[r >> 6]:
            self.mid[r >> 12] &= ~(1 << (r >> 6 & 63))
            if not self.mid[r >> 12]:
                self.top &= ~(1 << (r >> 12))
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def _printable_bytes() -> dict[str, int]:
    """The characters by which vocabulary files of this kind write bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    out |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    return out


def _merge_slowly(piece: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        r, i = min((ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
        if r >= below:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


@lru_cache(maxsize=1)
def unlike() -> re.Pattern:
    """The characters that the two engines class differently, such as numbers that aren't decimal digits; all beyond U+FFFF."""
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x10000))))
    pairs = ((r"\p{L}", r"[^\W\d_]"), (r"\p{N}", r"\d"), (r"\s", r"\s"))
    odd = set().union(*(set(regex.findall(a, every)) ^ set(re.findall(b, every)) for a, b in pairs))
    return re.compile("[" + "".join(map(re.escape, sorted(odd))) + f"\U00010000-{chr(sys.maxunicode)}]")


def pre_tokens(text: str) -> list[str]:
    return (PATTERN if unlike().search(text) else _QUICK).findall(text)


@lru_cache(maxsize=4)
def load_vocabulary(path: str = VOCABULARY) -> Bpe:
    """Read a ``.json`` (vocabulary and merges) or ``.tiktoken`` (ranks) file of a byte-level BPE."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte = _printable_bytes()
        special = lambda t: any(c not in byte for c in t)
        tokens = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if not special(t)}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        return Bpe(tokens, [(bytes(byte[c] for c in a), bytes(byte[c] for c in b)) for a, b in pairs])
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    merges = []
    for token, r in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) > 1 and len(parts := _merge_slowly(token, ranks, r)) == 2:
            merges.append((parts[0], parts[1]))
    return Bpe(ranks, merges)


def encode_texts(bpe: Bpe, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, offsets of each text's ids). A null text has no ids."""
    code: defaultdict[str, int] = defaultdict()
    code.default_factory = code.__len__
    codes, counts = [np.zeros(0, np.int32)], [0]
    for t in texts:  # a text's pre-tokens are dropped as soon as they have their numbers
        pieces = pre_tokens(t) if t else []
        codes.append(np.fromiter(map(code.__getitem__, pieces), np.int32, len(pieces)))
        counts.append(len(pieces))
    all_codes = np.concatenate(codes)
    flat, starts = bpe.encode_pieces([p.encode() for p in code])
    lengths = (starts[1:] - starts[:-1])[all_codes] if len(code) else np.zeros(0, np.int64)
    ids = flat[repeat_ranges(starts[all_codes], lengths)] if len(all_codes) else np.zeros(0, np.int32)
    return ids, np.r_[0, np.cumsum(lengths)][np.cumsum(counts)]


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_tokens INT, token_ids ARRAY<INT>, round_trip BOOLEAN`` for every row.

    ``round_trip`` says that decoding the ids gives the very bytes of the text. Nulls: a null
    text has null in all three; a null id stays null. An empty text has 0 tokens. Repeated
    rows give repeated results; other columns are dropped. A text of any length is encoded
    whole. No shuffle: one Arrow pass over the scan.
    """
    tables = df.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))
    narrow = pick(df, doc_id=id_col, text=text_col)
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tables.value
        for batch in slices(batches, limit=3 << 20):
            texts = batch.column("text")
            ids, offsets = encode_texts(bpe, texts.to_pylist())
            back, ends = bpe.decode_bytes(ids, offsets)
            valid = texts.is_valid()
            own = pc.fill_null(pc.cast(texts, pa.binary()), b"")
            length = pc.binary_length(own).to_numpy(zero_copy_only=False)
            data = np.frombuffer(b"".join(own.to_pylist()), np.uint8)
            right = length == ends[1:] - ends[:-1]
            if len(data) == len(back):
                wrong = np.r_[0, np.cumsum(data != back)]
                right = right & (wrong[ends[1:]] == wrong[ends[:-1]])
            missing = ~valid.to_numpy(zero_copy_only=False)
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32), mask=np.r_[missing, False]), pa.array(ids.astype(np.int32)))
            count = (offsets[1:] - offsets[:-1]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count, mask=missing), lists, pa.array(right, mask=missing)], ["doc_id", "n_tokens", "token_ids", "round_trip"])

    return narrow.mapInArrow(run, f"doc_id {kind}, n_tokens int, token_ids array<int>, round_trip boolean")


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "token_ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, text``: the text of each list of ids. Null list: null text; empty list: empty text.

    Null ids and ids outside the vocabulary are left out; bytes that aren't UTF-8 become U+FFFD.
    """
    tables = df.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))
    narrow = pick(df, doc_id=id_col, token_ids=ids_col)
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_id = tables.value.by_id
        for batch in batches:
            out = [None if x is None else b"".join(by_id[i] for i in x if i is not None and 0 <= i < len(by_id)).decode("utf-8", "replace") for x in batch.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return narrow.mapInArrow(run, f"doc_id {kind}, text string")
