"""Operator 8: toxicity by a bidirectional gated recurrent network with attention pooling.

Inputs of a word: an embedding of the word (of a vocabulary learned from the sample) and
the mean of embeddings of its byte trigrams. Two GRUs read a window of ``WINDOW`` words in
both directions; attention pools their states into one logit. Trained in numpy by
back-propagation through time. A text is scored by all windows at every ``STRIDE`` words,
and is as toxic as its most toxic window.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._frames import pick, slices, split_words

WINDOW, STRIDE = 24, 12
HIDDEN, WORD_DIM, CHAR_DIM, TRIGRAMS = 8, 8, 8, 4096
EDGES = ".,;:!?\"'()[]{}<>«»„“”‘’…*_`|#$%&"


def normal_words(words: pa.Array) -> pa.Array:
    return pc.utf8_trim(pc.utf8_lower(words), characters=EDGES)


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(trigram numbers of all words, offsets); a word of n bytes has n of them, its ends being marked."""
    data = [b"\x02" + w.encode() + b"\x03" for w in words]
    size = np.fromiter(map(len, data), np.int64, len(data))
    buf = np.frombuffer(b"".join(data), np.uint8).astype(np.uint32)
    offsets = np.r_[0, np.cumsum(size - 2)]
    if len(buf) < 3:
        return np.zeros(0, np.int64), offsets
    with np.errstate(over="ignore"):
        h = (buf[:-2] * np.uint32(0x9E3779B1) ^ buf[1:-1] * np.uint32(0x85EBCA6B) ^ buf[2:] * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F)
    ends = np.cumsum(size)
    use = np.ones(len(buf), bool)
    use[ends - 1] = use[ends - 2] = False
    return (h >> np.uint32(20)).astype(np.int64)[use[:-2]], offsets


@dataclass
class Model:
    words: dict[str, int]
    p: dict[str, np.ndarray]
    threshold: float = 0.5

    def inputs(self, words: list[str]) -> np.ndarray:
        """The input of each word, WORD_DIM + CHAR_DIM numbers."""
        ids = np.array([self.words.get(w, 0) for w in words], np.int64)
        tri, offsets = trigrams(words)
        n = offsets[1:] - offsets[:-1]
        chars = np.zeros((len(words), CHAR_DIM), np.float32)
        some = n > 0
        if some.any():
            chars[some] = np.add.reduceat(self.p["chars"][tri], offsets[:-1][some], axis=0) / n[some][:, None]
        return np.concatenate([self.p["words"][ids], chars], 1)

    def projected(self, words: list[str]) -> np.ndarray:
        """[direction, word, 3 * HIDDEN]: the part of the gates that depends on the word alone."""
        return (np.matmul(self.inputs(words), self.p["W"]) + self.p["b"][:, None]).astype(np.float32)

    def score(self, gates: np.ndarray, ids: np.ndarray, length: np.ndarray | None) -> np.ndarray:
        """Probability of each window: ids [windows, steps] of words in ``gates``; ``length`` where windows are short."""
        states = _forward(gates, ids, length, self.p["U"].astype(np.float32))[0]
        a = states @ self.p["v"].astype(np.float32)
        if length is not None:
            a = np.where(np.arange(ids.shape[1])[:, None] < length, a, -np.inf)
        a = np.exp(a - a.max(0))
        pooled = np.einsum("tb,tbh->bh", a, states) / a.sum(0)[:, None]
        return 1 / (1 + np.exp(-(pooled @ self.p["w"] + self.p["c"][0])))

    def windows(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word, probability) of all windows of all texts."""
        offsets, words = split_words(texts)
        coded = words.dictionary_encode()
        own = normal_words(coded.dictionary).to_pylist()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(words) else np.zeros(0, np.int64)
        doc, start = window_starts(offsets[1:] - offsets[:-1])
        out = np.zeros(len(doc))
        if len(doc):
            gates = self.projected(own)
            first = offsets[doc] + start
            length = np.minimum(offsets[doc + 1] - first, WINDOW)
            for rows in (np.flatnonzero(length == WINDOW), np.flatnonzero(length < WINDOW)):
                for a in range(0, len(rows), 2048):
                    r = rows[a : a + 2048]
                    short = length[r] if length[r[0]] < WINDOW else None
                    at = np.minimum(first[r][:, None] + np.arange(WINDOW), len(code) - 1)
                    out[r] = self.score(gates, code[at], short)
        return doc, start, out


def window_starts(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, first word) of the windows over texts of n words: every STRIDE words, the last one reaching the end."""
    count = np.where(n > WINDOW, -(-(n - WINDOW) // STRIDE) + 1, (n > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(n)), count)
    at = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
    return doc, np.maximum(np.minimum(at, n[doc] - WINDOW), 0)


def _forward(gates: np.ndarray, ids: np.ndarray, length: np.ndarray | None, u: np.ndarray, keep: bool = False):
    """States [step, window, 2 * HIDDEN] and, for training, what each step computed."""
    windows, steps = ids.shape
    h = np.zeros((2, windows, HIDDEN), np.float32)
    states = np.zeros((steps, windows, 2 * HIDDEN), np.float32)
    tape = []
    k = 2 * HIDDEN
    for t in range(steps):
        back = steps - 1 - t
        gx = np.stack([gates[0][ids[:, t]], gates[1][ids[:, back]]])
        gh = np.matmul(h, u)
        zr = 0.5 * np.tanh(0.5 * (gx[..., :k] + gh[..., :k])) + 0.5
        n = np.tanh(gx[..., k:] + zr[..., HIDDEN:] * gh[..., k:])
        new = n + zr[..., :HIDDEN] * (h - n)
        live = None
        if length is not None:
            live = np.stack([t < length, back < length])[..., None]
            new = np.where(live, new, h)
        if keep:
            tape.append((h, zr, n, gh[..., k:], live))
        h = new
        states[t, :, :HIDDEN] = h[0]
        states[back, :, HIDDEN:] = h[1]
    return states, tape


def loss_and_gradients(p: dict[str, np.ndarray], word_ids: np.ndarray, tri: np.ndarray, tri_offsets: np.ndarray, ids: np.ndarray, length: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean log loss over windows and its gradients; ``ids`` point into the words of ``word_ids`` and ``tri``."""
    n = np.maximum(tri_offsets[1:] - tri_offsets[:-1], 1)[:, None]
    owner = np.repeat(np.arange(len(word_ids)), tri_offsets[1:] - tri_offsets[:-1])
    chars = np.zeros((len(word_ids), CHAR_DIM), p["chars"].dtype)
    np.add.at(chars, owner, p["chars"][tri])
    x = np.concatenate([p["words"][word_ids], chars / n], 1)
    gates = np.matmul(x, p["W"]) + p["b"][:, None]
    states, tape = _forward(gates, ids, length, p["U"], keep=True)
    steps, windows = ids.shape[1], len(ids)
    inside = np.arange(steps)[:, None] < length
    a = np.where(inside, states @ p["v"], -np.inf)
    a = np.exp(a - a.max(0))
    a /= a.sum(0)
    pooled = np.einsum("tb,tbh->bh", a, states)
    q = 1 / (1 + np.exp(-(pooled @ p["w"] + p["c"][0])))
    loss = -np.mean(y * np.log(q + 1e-9) + (1 - y) * np.log(1 - q + 1e-9))
    d = (q - y) / windows
    g = {k: np.zeros_like(v) for k, v in p.items()}
    g["w"], g["c"] = pooled.T @ d, np.array([d.sum()])
    dp = d[:, None] * p["w"]
    da = np.einsum("bh,tbh->tb", dp, states)
    da = a * (da - (a * da).sum(0))
    g["v"] = np.einsum("tb,tbh->h", da, states)
    ds = a[..., None] * dp + da[..., None] * p["v"]
    dgates = np.zeros_like(gates)
    dh = np.zeros((2, windows, HIDDEN), ds.dtype)
    k = 2 * HIDDEN
    for t in reversed(range(steps)):
        back = steps - 1 - t
        h, zr, cand, ghn, live = tape[t]
        dh = dh + np.stack([ds[t, :, :HIDDEN], ds[back, :, HIDDEN:]])
        here = np.where(live, dh, 0)
        z, r = zr[..., :HIDDEN], zr[..., HIDDEN:]
        dn = here * (1 - z) * (1 - cand**2)
        dz = here * (h - cand) * z * (1 - z)
        dr = dn * ghn * r * (1 - r)
        dgx = np.concatenate([dz, dr, dn], -1)
        dgh = np.concatenate([dz, dr, dn * r], -1)
        g["U"] += np.matmul(h.transpose(0, 2, 1), dgh)
        np.add.at(dgates[0], ids[:, t], dgx[0])
        np.add.at(dgates[1], ids[:, back], dgx[1])
        dh = np.where(live, here * z, dh) + np.matmul(dgh, p["U"].transpose(0, 2, 1))
    g["b"] = dgates.sum(1)
    g["W"] = np.matmul(x.T, dgates)
    dx = np.matmul(dgates, p["W"].transpose(0, 2, 1)).sum(0)
    np.add.at(g["words"], word_ids, dx[:, :WORD_DIM])
    np.add.at(g["chars"], tri, (dx[:, WORD_DIM:] / n)[owner])
    return float(loss), g


def _parameters(vocabulary: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    d = WORD_DIM + CHAR_DIM
    shape = {"words": (vocabulary, WORD_DIM), "chars": (TRIGRAMS, CHAR_DIM), "W": (2, d, 3 * HIDDEN), "U": (2, HIDDEN, 3 * HIDDEN), "b": (2, 3 * HIDDEN), "v": (2 * HIDDEN,), "w": (2 * HIDDEN,), "c": (1,)}
    scale = {"words": 0.1, "chars": 0.3, "b": 0.0, "c": 0.0}
    return {k: (rng.normal(size=s) * scale.get(k, 0.3)).astype(np.float32) for k, s in shape.items()}


def _evidence(words: list[list[str]], y: np.ndarray) -> dict[str, float]:
    """Log odds of words and of their first 4 and 5 letters in toxic against other texts."""
    toxic, clean = Counter(), Counter()
    for own, t in zip(words, y):
        (toxic if t else clean).update({k for w in own for k in (w, w[:4] + "-", w[:5] + "-")})
    a, b = (y == 1).sum() + 1, (y == 0).sum() + 1
    return {k: float(np.log((n + 0.1) / a) - np.log((clean[k] + 0.5) / b)) for k, n in toxic.items() if n >= 3}


def fit(texts: list[str], toxic: np.ndarray, epochs: int = 6, batch: int = 192, seed: int = 3) -> Model:
    """Train on labelled texts; a fifth of them only choose the threshold. With one class, or none, the model finds nothing toxic.

    A label speaks for a text, not for a window. Positive windows are those around every place of
    strong evidence in a toxic text; negative ones are a text's most misleading and three at random.
    All words that occur four times in the sample have an embedding of their own.
    """
    rng = np.random.default_rng(seed)
    y = np.asarray(toxic, np.float32)
    if not len(y) or y.min() == y.max():
        return Model({}, _parameters(1, rng), 2.0)
    held = rng.random(len(y)) < 0.2
    offsets, flat = split_words(pa.array(texts, pa.string()))
    flat = normal_words(flat).to_pylist()
    words = [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
    used = [i for i in range(len(y)) if not held[i] and words[i]]
    odds = _evidence([words[i] for i in used], y[used])
    counts = Counter(w for i in used for w in words[i])
    vocabulary = {w: k + 1 for k, w in enumerate(w for w, n in counts.most_common() if n >= 4)}
    worth = {w: max(odds.get(w, -9.0), odds.get(w[:4] + "-", -9.0), odds.get(w[:5] + "-", -9.0)) for w in counts}
    rows, target = [], []
    for i in used:
        own = words[i]
        s = np.array([worth[w] for w in own])
        top = int(s.argmax())
        if y[i]:
            centres, end = [], -1
            for c in np.flatnonzero(s > max(s[top] - 1.0, 0)).tolist() or [top]:
                if c > end:  # what is near it is in its window
                    centres.append(c)
                    end = c + WINDOW // 2
        else:
            centres = [top, *rng.integers(0, len(own), 3).tolist()]
        for c in centres:
            a = max(0, min(c - int(rng.integers(0, WINDOW)), len(own) - WINDOW))
            rows.append(own[a : a + WINDOW])
            target.append(y[i])
    target = np.array(target, np.float32)
    p = _parameters(len(vocabulary) + 1, rng)
    mean, square, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), batch):
            r = order[a : a + batch]
            known: dict[str, int] = {}
            ids = np.zeros((len(r), WINDOW), np.int64)
            length = np.array([len(rows[i]) for i in r])
            for k, i in enumerate(r):
                ids[k, : len(rows[i])] = [known.setdefault(w, len(known)) for w in rows[i]]
            tri, tri_offsets = trigrams(list(known))
            # now and then a known word is read by its letters only, as unknown ones will be
            word_ids = np.array([vocabulary.get(w, 0) if rng.random() > 0.3 else 0 for w in known])
            _, g = loss_and_gradients(p, word_ids, tri, tri_offsets, ids, length, target[r])
            step += 1
            rate = 0.02 if epoch < epochs - 2 else 0.005
            for k in p:
                mean[k] = 0.9 * mean[k] + 0.1 * g[k]
                square[k] = 0.99 * square[k] + 0.01 * g[k] ** 2
                p[k] = (p[k] - rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    model = Model(vocabulary, p)
    at = np.flatnonzero(held) if held.any() and 0 < y[held].sum() < held.sum() else np.arange(len(y))
    best = document_scores(model, [texts[i] for i in at])
    model.threshold = _best_threshold(best, y[at])
    return model


def document_scores(model: Model, texts: list[str | None]) -> np.ndarray:
    doc, _, value = model.windows(pa.array(texts, pa.string()))
    out = np.zeros(len(texts))
    np.maximum.at(out, doc, value)
    return out


def _best_threshold(score: np.ndarray, y: np.ndarray) -> float:
    """The middle of the widest gap between scores that gives the best F1."""
    order = np.argsort(-score)
    s, hits = score[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(s) + 1) + y.sum())
    cut = np.r_[s[:-1] > s[1:], True]
    best = max(range(len(s)), key=lambda i: (cut[i], round(float(f1[i]), 4), float(s[i] - (s[i + 1] if i + 1 < len(s) else 0))))
    return float((s[best] + (s[best + 1] if best + 1 < len(s) else 0)) / 2)


def train(documents: DataFrame, labels: DataFrame, max_labelled: int = 4000, **options) -> Model:
    """Fit on at most ``max_labelled`` labelled texts, those of least hash, up to half of them toxic.

    Of repeated labels the toxic one counts, of repeated ids the least text; rows with a null are left out. The
    sample's whole texts go to the driver.
    """
    own = pick(labels, doc_id="doc_id", toxic="toxic").dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    half = max_labelled // 2
    part = lambda on: own.where((F.col("toxic") > 0) == on).orderBy(F.xxhash64("doc_id"), "doc_id").limit(half)
    sample = F.broadcast(part(True).unionByName(part(False)))  # at most max_labelled rows of two numbers
    rows = pick(documents, doc_id="doc_id", text="text").dropna().join(sample, "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).toPandas().sort_values("doc_id")
    return fit(rows["text"].tolist(), (rows["toxic"].to_numpy() > 0).astype(np.float32), **options)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, windows INT, toxicity DOUBLE, worst_word INT, toxic BOOLEAN`` for every row.

    ``worst_word`` is the first word of the most toxic window (the first of equals), null
    without words. A null or empty text has no windows and toxicity 0, a text of any length all of its
    windows. Repeated rows get equal results; a null id stays null; other columns are dropped; an
    empty table gives an empty result. No shuffle.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    narrow = pick(df, doc_id=id_col, text=text_col)
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches):
            doc, start, value = m.windows(batch.column("text"))
            count = np.bincount(doc, minlength=batch.num_rows)
            best, worst = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int32)
            some = count > 0
            if len(doc):
                first = (np.cumsum(count) - count)[some]
                best[some] = np.maximum.reduceat(value, first)
                order = np.lexsort((start, -value, doc))
                worst[some] = start[order][first]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(count.astype(np.int32)), pa.array(np.round(best, 6)), pa.array(worst, mask=~some), pa.array(best >= m.threshold)],
                ["doc_id", "windows", "toxicity", "worst_word", "toxic"],
            )

    return narrow.mapInArrow(run, f"doc_id {kind}, windows int, toxicity double, worst_word int, toxic boolean")
