"""Words of whole batches of texts, in Arrow: what expressions would do one word at a time."""

from __future__ import annotations

from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text that are split at once, one text at least.
BYTES = 16 << 20


def runs(texts: pa.Array, size: int = BYTES) -> Iterator[tuple[int, int]]:
    """(first, last) of runs of texts of up to ``size`` bytes, one text at least."""
    ends = np.cumsum(np.r_[0, pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)].astype(np.int64))
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + size, "right")) - 1)
        yield first, last
        first = last


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(offsets of each text's words, all words) between ASCII white space; a null text has none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
    words, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    keep = np.r_[False, pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)]
    return np.cumsum(keep)[offsets - offsets[0]], words.filter(pa.array(keep[1:]))


def gram_counts(df: DataFrame, tokens_col: str, n: int, stop: Collection[str] = (), longer_than: int | None = None) -> DataFrame:
    """``ngram ARRAY<STRING>, n``: neighbouring tokens inside a row, those with a word of ``stop`` in any case or, where
    there are stop words, a null left out; shorter tokens go beforehand. Rows are partial counts of ``BYTES`` of tokens at
    most, to be added up.
    """
    gone = {w.lower() for w in stop}

    def counted(lists: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        flat, rows, before = [], [], 0
        for own in lists:
            own = own.drop_null()
            words, size = own.flatten(), pc.list_value_length(own).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(own)), size)
            if longer_than is not None:
                keep = pc.fill_null(pc.greater(pc.utf8_length(words), longer_than), False)
                words, row = words.filter(keep), row[keep.to_numpy(zero_copy_only=False)]
            flat.append(words)
            rows.append(row + before)
            before += len(own)
        if not flat:
            return
        words, row = pa.concat_arrays(flat).dictionary_encode(), np.concatenate(rows)
        names, size = words.dictionary, len(words.dictionary)
        code = pc.fill_null(words.indices, size).to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.flatnonzero(row[n - 1 :] == row[: len(row) - n + 1]) if len(row) >= n else np.zeros(0, np.int64)
        if gone:
            bad = np.fromiter((w.lower() in gone for w in names.to_pylist()), bool, size)
            fine = ~np.r_[bad, True][code]
            for k in range(n):
                at = at[fine[at + k]]
        if not len(at):
            return
        key = code[at]
        for k in range(1, n):
            if k > 1:
                key = np.unique(key, return_inverse=True)[1]
            key = key * (size + 1) + code[at + k]
        _, first, count = np.unique(key, return_index=True, return_counts=True)
        for low in range(0, len(first), 200_000):
            some = slice(low, low + 200_000)
            own = code[(at[first[some]][:, None] + np.arange(n)).ravel()]
            values = names.take(pa.array(own, mask=own == size))
            ngram = pa.ListArray.from_arrays(pa.array(np.arange(len(first[some]) + 1, dtype=np.int32) * n), values)
            yield pa.RecordBatch.from_arrays([ngram, pa.array(count[some])], names=["ngram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch.column(0))
            size += batch.nbytes
            if size > BYTES:
                yield from counted(held)
                held, size = [], 0
        yield from counted(held)

    return df.select(tokens_col).mapInArrow(run, "ngram array<string>, n long")
