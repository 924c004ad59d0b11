"""Operator 5: benchmark decontamination by BM25 with block-max WAND.

Test items are cut into segments of up to ``SEGMENT`` words, which an inverted index holds:
for each term its segments in order, with their BM25 impacts. Segments lie in blocks, and
blocks in larger blocks, that know each term's greatest impact inside. Impacts are divided by
the segment's score for itself, so 1 is a copy and one threshold serves all. Every training
text is cut into overlapping passages, and every passage is a query. For all passages of a
batch at once, the terms' block maxima are added up, larger blocks first; blocks whose sum
can't reach the threshold are skipped, and WAND runs in the others, with the block maxima as
its second bound. So all segments at or above the threshold are retrieved. An item
that was retrieved is verified on the text around the passage: enough neighbouring word
pairs of its question, and enough of its answer, must occur there.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quillon.llm._frames import pick, slices, split_words

PASSAGE, STRIDE, SEGMENT = 64, 32, 48
#: Segments of a block, and blocks of a larger block.
BLOCK, LARGER = 4, 4
#: Words of items that one index holds, which bounds its table of block maxima.
INDEX_WORDS = 20_000
#: Indexes that one pass over the texts broadcasts; a larger benchmark makes more passes.
INDEXES = 500
#: Up to so many indexes, some 8 MB each, a Python worker keeps their tables of block maxima.
KEPT = 12
#: Passages whose bounds are worked out at a time.
QUERIES = 2048
EDGES = ".,;:!?\"'()[]{}<>«»„“”‘’…*_`|#$%&"


def normalise(words: pa.Array) -> pa.Array:
    return pc.utf8_trim(pc.utf8_lower(words), characters=EDGES)


def _words(text: str) -> list[str]:
    return [w for w in normalise(split_words(pa.array([text], pa.string()))[1]).to_pylist() if w]


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The words of an item's last sentence are its answer, if another one comes before; else those of its last quarter."""
    parts, start = [], 0
    for i, c in enumerate(text):
        if c in ".?!\n" and _words(text[start : i + 1]):
            parts.append(text[start : i + 1])
            start = i + 1
    if _words(text[start:]):
        parts.append(text[start:])
    if len(parts) > 1:
        return _words("".join(parts[:-1])), _words(parts[-1])
    own = _words(text)
    at = len(own) - max(1, len(own) // 4)
    return own[:at], own[at:]


@dataclass
class Item:
    item_id: object
    question: list[str]
    answer: list[str]


def segments_of(item: Item) -> list[Counter]:
    """The item's words in parts of equal size, of up to SEGMENT words."""
    own = item.question + item.answer
    size = math.ceil(len(own) / math.ceil(len(own) / SEGMENT)) if own else 1
    return [Counter(own[a : a + size]) for a in range(0, len(own), size)]


@dataclass
class Statistics:
    """Counts over the segments of the whole benchmark."""

    segments: int
    words: int
    df: Counter

    @staticmethod
    def of(items: list[Item]) -> Statistics:
        out = Statistics(0, 0, Counter())
        for item in items:
            for t in segments_of(item):
                out.segments += 1
                out.words += sum(t.values())
                out.df.update(t.keys())
        return out


class Index:
    """Inverted index of item segments with block maxima."""

    def __init__(self, items: list[Item], stats: Statistics | None = None, k1: float = 1.2, b: float = 0.75):
        self.items = items
        self.keep, self.kept = False, None
        stats = stats or Statistics.of(items)
        self.segments: list[int] = []
        postings = defaultdict(list)
        for i, item in enumerate(items):
            for t in segments_of(item):
                norm = k1 * (1 - b + b * sum(t.values()) * stats.segments / stats.words)
                impact = {w: math.log(1 + (stats.segments - stats.df[w] + 0.5) / (stats.df[w] + 0.5)) * f * (k1 + 1) / (f + norm) for w, f in t.items()}
                own = sum(impact.values())
                for w, x in impact.items():
                    postings[w].append((len(self.segments), x / own))
                self.segments.append(i)
        self.terms = sorted(postings)
        self.number = {w: i for i, w in enumerate(self.terms)}
        self.docs = [[s for s, _ in postings[w]] for w in self.terms]
        self.impacts = [[x for _, x in postings[w]] for w in self.terms]
        self.top = np.array([max(x) for x in self.impacts] + [0.0])  # the last: any other word
        self.pairs = []
        for item in items:
            code = lambda ws: [self.number[w] for w in ws]
            q, a = code(item.question), code(item.answer)
            # an answer of one word pairs with the word before it
            self.pairs.append((_bigrams(q), _bigrams(q[-1:] + a if len(a) < 2 else a)))

    def maxima(self) -> np.ndarray:
        """[term, larger block, block]: the greatest impact; the last term is any other word."""
        if self.kept is not None:
            return self.kept
        larger = max(1, -(-len(self.segments) // (BLOCK * LARGER)))
        out = np.zeros((len(self.terms) + 1, larger * LARGER), np.float32)
        term = np.repeat(np.arange(len(self.terms)), [len(x) for x in self.docs])
        at = np.array([s for x in self.docs for s in x], np.int64) // BLOCK
        np.maximum.at(out, (term, at), np.array([x for xs in self.impacts for x in xs], np.float32))
        out = out.reshape(len(self.terms) + 1, larger, LARGER)
        if self.keep:
            self.kept = out
        return out

    def search(self, terms: list[int], threshold: float, maxima: np.ndarray, low: int = 0, high: int | None = None) -> list[tuple[int, float]]:
        """All (segment, score) of segments in [low, high) with a score of at least ``threshold``, by block-max WAND."""
        eps = threshold - 1e-9
        high = len(self.segments) if high is None else min(high, len(self.segments))
        flat = maxima.reshape(len(maxima), -1)
        lists = [[bisect_left(self.docs[t], low), t] for t in terms]  # (place in the list, term)
        out = []
        while True:
            lists = [x for x in lists if x[0] < len(self.docs[x[1]]) and self.docs[x[1]][x[0]] < high]
            lists.sort(key=lambda x: self.docs[x[1]][x[0]])
            bound, pivot = 0.0, -1
            for k, (_, t) in enumerate(lists):
                bound += self.top[t]
                if bound >= eps:
                    pivot = k
                    break
            if pivot < 0:
                return out
            doc = self.docs[lists[pivot][1]][lists[pivot][0]]
            while pivot + 1 < len(lists) and self.docs[lists[pivot + 1][1]][lists[pivot + 1][0]] == doc:
                pivot += 1
            # the greatest score that the block of doc allows, and the last segment that it speaks for
            block = doc // BLOCK
            if sum(float(flat[t, block]) for _, t in lists[: pivot + 1]) >= eps - 1e-5:
                score = 0.0
                for x in lists[: pivot + 1]:
                    docs = self.docs[x[1]]
                    while x[0] < len(docs) and docs[x[0]] < doc:
                        x[0] += 1
                    if x[0] < len(docs) and docs[x[0]] == doc:
                        score += self.impacts[x[1]][x[0]]
                        x[0] += 1
                if score >= eps:
                    out.append((doc, score))
            else:
                after = (block + 1) * BLOCK
                if pivot + 1 < len(lists):
                    after = min(after, self.docs[lists[pivot + 1][1]][lists[pivot + 1][0]])
                after = max(after, doc + 1)
                for x in lists[: pivot + 1]:
                    docs = self.docs[x[1]]
                    while x[0] < len(docs) and docs[x[0]] < after:
                        x[0] += 1


def _bigrams(codes: list[int]) -> set[tuple[int, int]]:
    return set(zip(codes, codes[1:])) if len(codes) > 1 else {(c, c) for c in codes}


def load_indexes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> list[Index]:
    """Indexes of up to INDEX_WORDS words each, with statistics over all. Items with a null id or without words are left out; repeats count once."""
    rows = {(r["item_id"], r["text"]) for r in pick(benchmark, item_id=id_col, text=text_col).dropna().toLocalIterator()}
    groups: list[list[Item]] = [[]]
    total = 0
    for item_id, text in sorted(rows):
        q, a = question_and_answer(text)
        if not q + a:
            continue
        if total + len(q + a) > INDEX_WORDS and groups[-1]:
            groups.append([])
            total = 0
        groups[-1].append(Item(item_id, q, a))
        total += len(q + a)
    stats = Statistics.of([i for g in groups for i in g])
    out = [Index(g, stats) for g in groups]
    for index in out:
        index.keep = len(out) <= KEPT
    return out


def _codes(offsets: np.ndarray, coded: pa.DictionaryArray, own: pa.Array, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of each text's words, the index's number of each word): what is only punctuation isn't a word."""
    code = pc.index_in(own, value_set=pa.array(index.terms, own.type))
    code = pc.fill_null(code, len(index.terms)).to_numpy(zero_copy_only=False).astype(np.int32)
    code = np.where(pc.equal(pc.binary_length(own), 0).to_numpy(zero_copy_only=False), -1, code)[coded.indices.to_numpy(zero_copy_only=False)]
    word = code >= 0
    return np.r_[0, np.cumsum(word)][offsets], code[word]


def retrieve(offsets: np.ndarray, code: np.ndarray, index: Index, threshold: float) -> Iterator[tuple[int, int, int, list[tuple[int, float]]]]:
    """(text, start, end, segments and scores) of every passage that some segment reaches the threshold for."""
    n = offsets[1:] - offsets[:-1]
    passages = np.where(n > PASSAGE, -(-(n - PASSAGE) // STRIDE) + 1, (n > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(n)), passages)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(passages) - passages, passages)
    start = offsets[doc] + at * STRIDE
    end = np.minimum(start + PASSAGE, offsets[doc + 1])
    sums = np.r_[0, np.cumsum(index.top[code])]
    some = np.flatnonzero(sums[end] - sums[start] >= threshold - 1e-6)
    other, eps = len(index.terms), threshold - 1e-4  # the maxima are single precision
    maxima = index.maxima()
    larger = maxima.max(2)
    step = max(1, min(QUERIES, (64 << 20) // (4 * PASSAGE * larger.shape[1])))
    for a in range(0, len(some), step):
        p = some[a : a + step]
        place = start[p][:, None] + np.arange(PASSAGE)
        terms = np.where(place < end[p][:, None], code[np.minimum(place, len(code) - 1)], other)
        terms.sort(axis=1)
        terms[:, 1:][terms[:, 1:] == terms[:, :-1]] = other
        open_ = np.flatnonzero(index.top[terms].sum(1) >= threshold - 1e-6)
        terms, p = terms[open_], p[open_]
        row, block = np.nonzero(larger[terms].sum(1) >= eps)
        blocks: dict[int, list[int]] = defaultdict(list)
        for b in range(0, len(row), 8192):
            r, k = row[b : b + 8192], block[b : b + 8192]
            x, y = np.nonzero(maxima[terms[r], k[:, None]].sum(1) >= eps)
            for i, j in zip(r[x].tolist(), (k[x] * LARGER + y).tolist()):
                blocks[i].append(j)
        for i, own in sorted(blocks.items()):
            t = terms[i][terms[i] < other].tolist()
            found = [hit for j in own for hit in index.search(t, threshold, maxima, j * BLOCK, (j + 1) * BLOCK)]
            if found:
                yield int(doc[p[i]]), int(start[p[i]]), int(end[p[i]]), found


def scan(texts: pa.Array, indexes: list[Index], threshold: float, overlap: float) -> Iterator[tuple[int, object, float, float, float]]:
    """(text, item id, score, question overlap, answer overlap) of every verified item, the texts in order for each index."""
    all_offsets, words = split_words(texts)
    if not len(words):
        return
    coded = words.dictionary_encode()
    own = normalise(coded.dictionary)
    for index in indexes:
        if not index.terms:
            continue
        offsets, code = _codes(all_offsets, coded, own, index)
        if not len(code):
            return
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        for d, start, end, hits in retrieve(offsets, code, index, threshold):
            for s, score in hits:
                item = index.segments[s]
                questions, answers = index.pairs[item]
                reach = len(index.items[item].question) + len(index.items[item].answer)
                around = code[max(offsets[d], start - reach) : min(offsets[d + 1], end + reach)].tolist()
                here = set(zip(around, around[1:])) | {(c, c) for c in around}
                q = len(questions & here) / len(questions) if questions else 1.0
                a = len(answers & here) / len(answers) if answers else 1.0
                old = best.get((d, item), (0.0, -1.0, 0.0))
                if q >= overlap and a >= overlap and (q + a, score) > (old[1] + old[2], old[0]):
                    best[d, item] = (score, q, a)
        for (d, item), (score, q, a) in sorted(best.items()):
            yield d, index.items[item].item_id, round(min(score, 1.0), 6), round(q, 6), round(a, 6)


def find(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.4, overlap: float = 0.6) -> DataFrame:
    """``doc_id, item_id, score DOUBLE, question_overlap DOUBLE, answer_overlap DOUBLE``: every contaminated document and item.

    Words are compared in lower case without punctuation at their ends. Null or empty texts
    contain nothing; repeated rows give repeated results; a null doc_id stays null; an empty
    benchmark gives an empty result; extra columns are dropped. No shuffle: up to INDEXES
    indexes of INDEX_WORDS words are broadcast to a pass over the texts.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = documents.sparkSession
    docs = pick(documents, doc_id=id_col, text=text_col)
    item = pick(benchmark, item_id="item_id").schema["item_id"].dataType
    kinds, item_type = (docs.schema["doc_id"].dataType.simpleString(), item.simpleString()), to_arrow_type(item)
    indexes, out = load_indexes(benchmark), None
    for a in range(0, len(indexes), INDEXES):
        shared = spark.sparkContext.broadcast(indexes[a : a + INDEXES])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                rows = list(scan(batch.column("text"), shared.value, threshold, overlap))
                d, i, s, q, a = zip(*rows) if rows else ((), (), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(d, pa.int64())), pa.array(i, item_type), *(pa.array(x, pa.float64()) for x in (s, q, a))],
                    ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"],
                )

        part = docs.mapInArrow(run, f"doc_id {kinds[0]}, item_id {kinds[1]}, score double, question_overlap double, answer_overlap double")
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", threshold: float = 0.4, overlap: float = 0.6) -> DataFrame:
    """The documents that hold no item; all columns.

    Decided row by row in the scan, so rows of equal id, or of none, don't decide for each other. Null, empty
    and blank texts stay; whole texts of any length are searched; an empty benchmark drops nothing, and an
    empty table stays empty.
    """
    flat = documents.toDF(*[f"_c{i}" for i in range(len(documents.columns))])
    schema = flat.schema
    text = f"_c{documents.columns.index(text_col)}"
    indexes = load_indexes(benchmark)
    for a in range(0, len(indexes), INDEXES):
        shared = documents.sparkSession.sparkContext.broadcast(indexes[a : a + INDEXES])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, text):
                keep = np.ones(batch.num_rows, bool)
                keep[[d for d, *_ in scan(batch.column(text), shared.value, threshold, overlap)]] = False
                yield batch.filter(pa.array(keep))

        flat = flat.mapInArrow(run, schema)
    return flat.toDF(*documents.columns)
