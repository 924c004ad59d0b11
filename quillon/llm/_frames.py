"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.sources.checkpoints import Cut, cut  # noqa: F401

#: Bytes of text that one vectorised step handles; bounds a Python worker's memory.
SLICE_BYTES = 6 << 20


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Select ``new=old`` columns by position, so that extra columns, even ones whose
    names differ in case only, can't make a reference ambiguous."""
    names = [f"_q{i}" for i in range(len(df.columns))]
    place = {c: names[i] for i, c in reversed(list(enumerate(df.columns)))}
    flat = df.toDF(*names)
    return flat.select(*[F.col(place[old]).alias(new) for new, old in columns.items()])


#: Keys with more rows than this, and than a thousandth of all rows, are hot.
HOT_ROWS, HOT_SHARE = 1_000_000, 1_000
#: Rows of two numbers that a broadcast may have, some 32 MB; larger frames are joined by shuffle.
BROADCAST_KEYS = 500_000


def join_hot(left: DataFrame, right: DataFrame, key: str | list[str], size: str, how: str = "inner") -> DataFrame:
    """``left.join(right, key, how)`` where ``right`` has a row a key and counts the key's rows of ``left`` in ``size``.

    Rows of hot keys, of which there are a thousand at most, are joined where they are; the rest by shuffle.
    Both frames are read more than once.
    """
    most, total = right.agg(F.max(size), F.sum(size)).first()
    limit = max(HOT_ROWS, (total or 0) // HOT_SHARE)
    if (most or 0) <= limit:
        return left.join(right, key, how)
    hot = right.where(F.col(size) > limit)
    own = F.broadcast(hot)  # at most HOT_SHARE rows, by the choice of the limit
    rest = left.join(F.broadcast(hot.select(*[key] if isinstance(key, str) else key)), key, "left_anti")
    return left.join(own, key).unionByName(rest.join(right.where(F.col(size) <= limit), key, how))


def few(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A broadcast hint if the frame, of a few numbers a row, has no more rows than ``BROADCAST_KEYS``."""
    rows = BROADCAST_KEYS if rows is None else rows
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each has about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(size) - size) // limit
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], batch.num_rows]):
            yield batch.slice(int(a), int(b - a))
            give_back()


def give_back() -> None:
    """Return freed memory to the system: Python workers live on from task to task, beside each other and the JVM."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def split_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.Array]:
    """Words between ASCII white space: (offsets of each text's words, all words). A null text has none."""
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.utf8_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    words, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(words), 0)
    keep = full.to_numpy(zero_copy_only=False)
    if not keep.all():
        offsets = np.r_[0, np.cumsum(keep)][offsets]
        words = words.filter(full)
    return offsets, words


def repeat_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every range, one range after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each segment; 0 for an empty one."""
    total = np.concatenate([np.zeros((1,) + values.shape[1:], np.float64 if values.dtype.kind == "f" else np.int64), np.cumsum(values, axis=0, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix64(x: np.ndarray) -> np.ndarray:
    """A well mixed 64-bit value of each value (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX[0]
        x = (x ^ (x >> np.uint64(27))) * _MIX[1]
        return x ^ (x >> np.uint64(31))


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word; each distinct word is hashed once."""
    import xxhash

    coded = words.dictionary_encode()
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return own[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.uint64)
