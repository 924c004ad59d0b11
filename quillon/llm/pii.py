"""Operator 2: personal data and secrets by a skip-chain conditional random field.

Nodes are the pieces between white space, or between separators where a piece has no
shape as it is, that can be part of an entity: those with a digit, ``@``, ``=`` or a
long run of capitals. Every other piece can only be "no entity"
(a structural zero of the model), so no message passes through it, and leaving it out
of the graph is exact. Edges join neighbouring pieces (the chain) and, across the whole
document, each piece with the next one of the same content (the skip edges, with a
potential of their own for equal labels). Loopy belief propagation over all documents
of a batch at once gives the marginals; training ascends the likelihood on generated
documents with the same inference.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm._frames import pick, slices

LABELS = ("O", "EMAIL", "PHONE", "IP", "CARD", "ID", "SECRET")
_HIT = re.compile(r"[0-9@=]|[A-Z]{12}")
_SPACE = " \t\n\r\x0b\x0c"
_BLANK = re.compile(f"[{_SPACE}]")
_LONG = re.compile(f"[^{_SPACE}]{{25}}")
_SECRET = r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|key|auth|bearer|credential)s?"
_EDGES = ".,;:!?\"'<>[]{}«»„“”*|`~"
#: Signs that, repeated at an end, are ornament.
_ORNAMENT = "#$%&"

#: Features that look at a piece itself.
_SHAPES: tuple[tuple[str, re.Pattern], ...] = tuple(
    (n, re.compile(p))
    for n, p in (
        ("email", r"[\w.+%-]+@[\w-]+(?:\.[\w-]+)+"),
        ("ip", r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?::\d{1,5})?"),
        ("dotted", r"\d+(?:\.\d+){1,2}|\d+(?:\.\d+){4,}"),
        ("country_code", r"\+\d{1,3}"),
        ("area_code", r"\(\d{2,4}\)"),
        ("local_number", r"\d{3,4}-\d{3,4}"),
        ("full_number", r"(?:\+\d{1,3}[-.]?)?\(?\d{3}\)?[-.]\d{3}[-.]\d{4}|\+\d{10,14}"),
        ("ssn", r"\d{3}-\d{2}-\d{4}"),
        ("iban", r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}"),
        ("date", r"\d{4}-\d{1,2}-\d{1,2}|\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}"),
        ("time", r"\d{1,2}:\d{2}(?::\d{2})?"),
        ("digits_1_3", r"\d{1,3}"),
        ("digits_4", r"\d{4}"),
        ("digits_5_9", r"\d{5,9}"),
        ("digits_10_12", r"\d{10,12}"),
        ("digits_13_19", r"\d{13,19}"),
        ("digits_20", r"\d{20,}"),
        ("card_grouped", r"\d{4}(?:-\d{4}){2,3}-?\d{0,4}"),
        ("money", r"[$€£]\d[\d.,]*|\d[\d.,]*[$€£%]"),
        ("hex", r"(?=[^a-z]*[a-z])(?=\D*\d)[0-9a-f]{16,}|(?=[^A-Z]*[A-Z])(?=\D*\d)[0-9A-F]{16,}"),
        ("upper_key", r"(?=[A-Z]*\d)(?=[0-9]*[A-Z])[A-Z0-9]{16,40}"),
        ("cloud_key", r"(?:AKIA|ASIA)[A-Z0-9]{14,18}"),
        ("prefixed_key", r"(?:sk|pk|ghp|gho|xox[abp]|glpat)[-_][\w-]{10,}"),
        ("mixed_long", r"(?=.*\d)(?=.*[a-z])(?=.*[A-Z])[\w+/=-]{16,}"),
        ("secret_value", rf"(?i:{_SECRET})[=:].{{6,}}"),
        ("plain_value", r"[A-Za-z]{1,12}=.{1,5}"),
        ("equals", r"="),
        ("letters_digits", r"[A-Za-z]+\d{1,3}|\d{1,3}[A-Za-z]{1,4}"),
        ("handle", r"@\w+|\w+@"),
        ("capitals", r"[A-Z]+"),
    )
)
_CONTEXT: tuple[tuple[str, re.Pattern], ...] = tuple(
    (n, re.compile(p, re.I))
    for n, p in (
        ("after_secret", _SECRET + "[:=]?"),
        ("after_phone", r"(?:phone|tel|telephone|call|fax|mobile|cell|whatsapp)[:.]?"),
        ("after_card", r"(?:card|visa|mastercard|amex|credit)[:.]?"),
        ("after_id", r"(?:ssn|iban|passport|social)[:.]?"),
        ("after_equals", r"="),
        ("after_is", r"(?:is|was|to|at|from|by)[:]?"),
    )
)
_EXTRA = ("bias", "left_chained", "right_chained", "second_after_secret", "right_local_number", "left_area_code", "left_country_code", "right_area_code", "in_group_of_4", "length_24", "check_digit_right", "check_digit_wrong", "group_check_right")
FEATURES = [*(n for n, _ in _SHAPES), *(n for n, _ in _CONTEXT), *_EXTRA]
_AT = {n: i for i, n in enumerate(FEATURES)}


#: Letters of scripts without spaces, and full-width signs: always between pieces.
_FOREIGN = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uffef\U00020000-\U0003ffff"
#: Separators, the weaker ones last; a piece is cut at those of a level only if it has no shape as it is. Parentheses of an area code stay.
_CUTS = tuple(re.compile(p) for p in (f"[{_FOREIGN}]+", r"""[,;{}"'<>|&?!`«»„“”\\\[\]*]+""", r"[=:/]+", r"(?:\((?!\d{2,4}\))|(?<!\(\d\d)(?<!\(\d{3})(?<!\(\d{4})\))+"))
#: Another named value behind the first.
_NEXT_NAME = re.compile(r"""[,;&|}]["'{\[]*[A-Za-z_][\w.-]{0,40}["']*[=:]""")
#: Shapes for which a piece is cut. A long piece without one is a secret as a whole.
_OWN = {"email", "ip", "full_number", "ssn", "iban", "card_grouped", "digits_13_19", "secret_value"}
_SIGNS = re.compile(rf"[{_FOREIGN}\s,;{{}}\"'<>|&?!`«»„“”\\\[\]*=:/()]")


def _shapes(core: str) -> set[str]:
    return {n for n, p in _SHAPES if p.fullmatch(core)}


def _cut(text: str, a: int, b: int, level: int = 0) -> list[tuple[int, int]]:
    """The parts of text[a:b] that can be an entity of their own; all of it where it has a shape or no part has one of ``_OWN``."""
    a2, b2 = _core(text, a, b)
    if level:
        own = _shapes(text[a2:b2])
        if level == len(_CUTS) or own - {"secret_value"} or own and not _NEXT_NAME.search(text, a2, b2):
            return [(a, b)]
    out: list[tuple[int, int]] = []
    at = a2
    for m in (*_CUTS[level].finditer(text, a2, b2), None):
        end = m.start() if m else b2
        if m is None and at == a2:
            return _cut(text, a, b, level + 1)
        if _HIT.search(text, at, end):
            out += _cut(text, at, end, level + 1)
        at = m.end() if m else end
    if not out or level and not any(_shapes(text[slice(*_core(text, *x))]) & _OWN for x in out):
        return [(a, b)]
    return out


def _bounds(text: str, i: int) -> tuple[int, int]:
    a = b = i
    while a and text[a - 1] not in _SPACE:
        a -= 1
    n = len(text)
    while b < n and text[b] not in _SPACE:
        b += 1
    return a, b


def pieces(text: str) -> list[tuple[int, int]]:
    """(start, end) of the pieces that can be part of an entity."""
    out = []
    i = 0
    while m := _HIT.search(text, i):
        a, i = _bounds(text, m.start())
        out += _cut(text, a, i)
    return out


class _Left:
    """The words to the left of places in a text, however long they are; each sign that ends one is looked for once at most."""

    def __init__(self, text: str):
        self.text = text
        self.ends: dict[bool, list[int]] = {}

    def _start(self, b: int, glued: bool) -> int:
        """Where the word that ends at ``b`` begins."""
        a = b
        while a and b - a < 40 and not _ends_word(self.text[a - 1], glued):
            a -= 1
        if b - a < 40:
            return a
        if glued not in self.ends:
            self.ends[glued] = [m.end() for m in (_SIGNS if glued else _BLANK).finditer(self.text)]
        at = bisect_right(self.ends[glued], a)
        return self.ends[glued][at - 1] if at else 0

    def __call__(self, start: int) -> tuple[str, int]:
        """(the word before ``start``, its place)."""
        text, b = self.text, start
        glued = b > 0 and text[b - 1] not in _SPACE  # cut from what is before it
        while b and _ends_word(text[b - 1], glued) and (not glued or start - b < 40):
            b -= 1
        a = self._start(b, glued)
        return text[a:b], a


def _ends_word(c: str, glued: bool) -> bool:
    return bool(_SIGNS.match(c)) if glued else c in _SPACE


def _core(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and (text[a] in _EDGES or b - a > 1 and text[a] in _ORNAMENT and text[a + 1] == text[a]):
        a += 1 if text[a] in _EDGES else 2
        while a < b and text[a] in _ORNAMENT and text[a - 1] == text[a]:
            a += 1
    while a < b and (text[b - 1] in _EDGES or b - a > 1 and text[b - 1] in _ORNAMENT and text[b - 2] == text[b - 1]):
        b -= 1 if text[b - 1] in _EDGES else 2
        while a < b and text[b - 1] in _ORNAMENT and text[b] == text[b - 1]:
            b -= 1
    return min(a, b), b


def _luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of a payment card's number."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _content(core: str) -> str:
    """What makes two pieces the same or similar: the value after a name, without separators and case."""
    if "=" in core[:-1]:
        core = core.split("=", 1)[1]
    return re.sub(r"[\W_]+", "", core).lower()


class Graph:
    """Nodes, features and edges of a batch of texts."""

    def __init__(self, texts: list[str | None]):
        self.doc: list[int] = []
        self.span: list[tuple[int, int]] = []
        rows: list[int] = []
        cols: list[int] = []
        chain: list[tuple[int, int]] = []
        skip: list[tuple[int, int]] = []
        for d, text in enumerate(texts):
            seen: dict[str, int] = {}
            base = len(self.doc)
            spans = pieces(text) if text else []
            left_word = _Left(text or "")
            shapes = []
            run = 0  # pieces of four digits up to here
            for k, (a, b) in enumerate(spans):
                node = base + k
                a2, b2 = _core(text, a, b)
                core = text[a2:b2]
                own = _shapes(core)
                left, at = left_word(a)
                glued = a and text[a - 1] not in _SPACE or b < len(text) and text[b] not in _SPACE
                named = "secret_value" in own or glued and _CONTEXT[0][1].fullmatch(left)
                if len(core) > 24 or glued and named and _LONG.match(text, _bounds(text[a - 25 : a], 25)[0] + a - 25 if a >= 25 else _bounds(text[:a], a)[0]):  # a secret cut from a long piece
                    own.add("length_24")
                if own & {"digits_13_19", "card_grouped"}:
                    plain = core.replace("-", "")
                    own.add("check_digit_right" if plain.isascii() and _luhn(plain) else "check_digit_wrong")
                shapes.append(own)
                use = {n for n, p in _CONTEXT if p.fullmatch(left)} | own | {"bias"}
                chained = False
                if _CONTEXT[0][1].fullmatch(left_word(at)[0]):
                    use.add("second_after_secret")
                if k and not text[spans[k - 1][1] : a].strip(_SPACE) and "\n" not in text[spans[k - 1][1] : a]:
                    chain.append((node - 1, node))
                    chained = True
                    before = shapes[k - 1]
                    use.add("left_chained")
                    cols += [_AT[n] for n in ("right_chained",)]
                    rows += [node - 1]
                    for here, flag in (("area_code", "left_area_code"), ("country_code", "left_country_code")):
                        if here in before:
                            use.add(flag)
                    for here, flag in (("local_number", "right_local_number"), ("area_code", "right_area_code")):
                        if here in own:
                            rows.append(node - 1)
                            cols.append(_AT[flag])
                    if "digits_4" in own and "digits_4" in before:
                        rows += [node - 1, node]
                        cols += [_AT["in_group_of_4"]] * 2
                        run = run + 1 if run else 2
                        if run == 4:
                            number = "".join(text[x:y] for x, y in (_core(text, *spans[k - 3 + q]) for q in range(4)))
                            if number.isascii() and _luhn(number):
                                rows += range(node - 3, node + 1)
                                cols += [_AT["group_check_right"]] * 4
                    else:
                        run = 0
                else:
                    run = 0
                key = _content(core)
                if len(key) >= 5:
                    if key in seen and not (chained and seen[key] == node - 1):
                        skip.append((seen[key], node))
                    seen[key] = node
                rows += [node] * len(use)
                cols += [_AT[n] for n in use]
                self.doc.append(d)
                self.span.append((a2, b2) if b2 > a2 else (a, b))
        self.n = len(self.doc)
        self.rows, self.cols = np.array(rows, np.int64), np.array(cols, np.int64)
        edges = np.array(chain + skip, np.int64).reshape(-1, 2)
        self.edges, self.is_skip = edges, np.arange(len(edges)) >= len(chain)


def _parameters() -> dict[str, np.ndarray]:
    k = len(LABELS)
    return {"unary": np.zeros((len(FEATURES), k)), "chain": np.zeros((k, k)), "skip": np.zeros((k, k))}


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(-2, keepdims=True)
    return np.log(np.exp(x - top).sum(-2)) + top[..., 0, :]


def propagate(g: Graph, p: dict[str, np.ndarray], rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of nodes [n, labels] and of edges [e, labels, labels] by loopy belief propagation."""
    k = len(LABELS)
    own = np.zeros((g.n, k))
    np.add.at(own, g.rows, p["unary"][g.cols])
    e = len(g.edges)
    psi = np.where(g.is_skip[:, None, None], p["skip"], p["chain"]) if e else np.zeros((0, k, k))
    a, b = g.edges[:, 0], g.edges[:, 1]
    ahead, back = np.zeros((e, k)), np.zeros((e, k))
    belief = own
    for _ in range(rounds if e else 0):
        new_ahead = _log_sum((belief[a] - back)[:, :, None] + psi)
        new_back = _log_sum((belief[b] - ahead)[:, :, None] + psi.transpose(0, 2, 1))
        ahead = 0.5 * ahead + 0.5 * (new_ahead - new_ahead.max(1, keepdims=True))
        back = 0.5 * back + 0.5 * (new_back - new_back.max(1, keepdims=True))
        belief = own.copy()
        np.add.at(belief, b, ahead)
        np.add.at(belief, a, back)
    node = np.exp(belief - belief.max(1, keepdims=True))
    node /= node.sum(1, keepdims=True)
    pair = (belief[a] - back)[:, :, None] + (belief[b] - ahead)[:, None, :] + psi
    pair = np.exp(pair - pair.max((1, 2), keepdims=True)) if e else pair
    return node, pair / pair.sum((1, 2), keepdims=True) if e else pair


@lru_cache(maxsize=4)
def train(documents: int = 700, steps: int = 250, seed: int = 5, decay: float = 1e-3) -> dict[str, np.ndarray]:
    """Fit the potentials on ``documents`` generated texts."""
    texts, gold = generate(documents, seed)
    g = Graph(texts)
    y = np.zeros(g.n, np.int64)
    for i in range(g.n):
        a, b = g.span[i]
        y[i] = next((LABELS.index(label) for s, e, label in gold[g.doc[i]] if s < b and a < e), 0)
    k = len(LABELS)
    p = _parameters()
    mean, square = {n: np.zeros_like(v) for n, v in p.items()}, {n: np.zeros_like(v) for n, v in p.items()}
    hot = np.eye(k)[y]
    pair_hot = hot[g.edges[:, 0]][:, :, None] * hot[g.edges[:, 1]][:, None, :]
    for step in range(1, steps + 1):
        node, pair = propagate(g, p, rounds=8)
        d = {"unary": np.zeros_like(p["unary"])}
        np.add.at(d["unary"], g.cols, (hot - node)[g.rows])
        d["chain"] = (pair_hot - pair)[~g.is_skip].sum(0)
        same = (pair_hot - pair)[g.is_skip].sum(0)
        d["skip"] = np.diag(np.diag((same + same.T) / 2))  # a skip edge speaks of equal labels only
        for n in p:
            grad = d[n] - decay * g.n * p[n]
            mean[n] = 0.9 * mean[n] + 0.1 * grad
            square[n] = 0.99 * square[n] + 0.01 * grad**2
            p[n] = p[n] + 0.08 * (mean[n] / (1 - 0.9**step)) / (np.sqrt(square[n] / (1 - 0.99**step)) + 1e-6)
    return p


#: Potentials that ``train()`` has given; ``python -m quillon.llm.pii`` fits and writes them anew.
FITTED = Path(__file__).with_name("pii_potentials.json")


@lru_cache(maxsize=1)
def fitted() -> dict[str, np.ndarray]:
    """The potentials of ``train()``, read from their file."""
    own = json.loads(FITTED.read_text())
    if own["features"] != FEATURES or own["labels"] != list(LABELS):
        raise ValueError(f"{FITTED.name} is of other features: fit it anew")
    return {n: np.array(own[n]) for n in ("unary", "chain", "skip")}


def entities(texts: list[str | None], p: dict[str, np.ndarray]) -> list[list[tuple[int, int, str]]]:
    """(start, end, label) of the entities of each text, in characters, in order."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    g = Graph(texts)
    if not g.n:
        return out
    label = propagate(g, p)[0].argmax(1)
    chained = {int(b) for (a, b), s in zip(g.edges, g.is_skip) if not s}
    for i in range(g.n):
        if not label[i]:
            continue
        name, own, (a, b) = LABELS[label[i]], out[g.doc[i]], g.span[i]
        if name == "SECRET":
            text = texts[g.doc[i]]
            at = text.find("=", a, b - 1)
            if b - a == 1 and text[a] == "=":
                continue
            if at >= 0 and text[at:b].strip("="):  # else it's padding at the end
                a, b = _core(text, at + 1, b)
                if a >= b:
                    continue
        if own and own[-1][2] == name and i in chained and label[i - 1] == label[i] and name in ("PHONE", "CARD", "ID"):
            own[-1] = (own[-1][0], b, name)
        else:
            own.append((a, b, name))
    return out


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    parts, at = [], 0
    for a, b, name in found:
        parts += (text[at:a], f"<{name}>")
        at = b
    return "".join([*parts, text[at:]])


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, entities ARRAY<STRUCT<start INT, end INT, label STRING>>, text`` for every row.

    Positions count characters from 0, the end excluded; ``text`` has ``<LABEL>`` in the place of
    each entity. A null text stays null, an empty one empty, and neither has entities; pieces of any length are looked
    at whole. Of labels that are equally likely the first in ``LABELS`` counts, so "no entity" before any. Repeated rows
    give repeated results; a null id stays null; other columns are dropped; an empty table gives an empty result. Whole
    texts in one Arrow pass, no shuffle.
    """
    shared = df.sparkSession.sparkContext.broadcast(fitted())
    narrow = pick(df, doc_id=id_col, text=text_col)
    kind = narrow.schema["doc_id"].dataType.simpleString()
    entity = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            found = entities(texts, p)
            new = [t if not f else redact(t, f) for t, f in zip(texts, found)]
            rows = [[{"start": a, "end": b, "label": n} for a, b, n in f] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(entity)), pa.array(new, pa.string())], ["doc_id", "entities", "text"])

    return narrow.mapInArrow(run, f"doc_id {kind}, entities array<struct<start:int,end:int,label:string>>, text string")


def mask(documents: DataFrame) -> DataFrame:
    """All documents, each entity of ``text`` replaced by ``<LABEL>``; ``n_chars``, where there is one, follows.

    Rows, repeated ones too, stay in number and order of columns. A null text stays null, an empty one empty, and their
    ``n_chars`` as it is; texts of any length are masked whole, by the rules of ``find`` for ties; an empty table stays empty.
    """
    shared = documents.sparkSession.sparkContext.broadcast(fitted())
    flat = documents.toDF(*[f"_c{i}" for i in range(len(documents.columns))])
    at = documents.columns.index("text")
    size = documents.columns.index("n_chars") if "n_chars" in documents.columns else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in slices(batches, f"_c{at}"):
            texts = batch.column(at).to_pylist()
            found = entities(texts, p)
            new = [t if not f else redact(t, f) for t, f in zip(texts, found)]
            columns = batch.columns
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if size >= 0:
                old = columns[size].to_pylist()
                columns[size] = pa.array([len(t) if f else n for t, f, n in zip(new, found, old)], batch.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return flat.mapInArrow(run, flat.schema).toDF(*documents.columns)


def generate(documents: int, seed: int) -> tuple[list[str], list[list[tuple[int, int, str]]]]:
    """Texts of invented words with entities and with numbers that are none, and the entities' places."""
    rng = np.random.default_rng(seed)
    one = lambda xs: xs[int(rng.integers(len(xs)))]
    text_of = lambda chars, n: "".join(one(chars) for _ in range(n))
    digits, lower, upper = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    number = lambda n: text_of(digits, n)
    between = lambda a, b: int(rng.integers(a, b + 1))

    def long_hex(n: int) -> str:
        while True:
            h = text_of("0123456789abcdef", n)
            if re.search("[a-f]", h) and re.search("[0-9]", h):
                return h

    def card(right: bool) -> list[str]:
        while True:
            x = number(16)
            if _luhn(x) == right:
                return [x[i : i + 4] for i in range(0, 16, 4)]

    def entity() -> tuple[str, str, str]:
        """(text before, entity, label)."""
        kind = one(("EMAIL", "PHONE", "IP", "CARD", "ID", "SECRET", "SECRET"))
        if kind == "EMAIL":
            who = text_of(lower, between(2, 9)) + one(("", "." + number(2), "_" + text_of(lower, 4), number(2)))
            return one(("", "", "mail ")), f"{who}@{text_of(lower, between(3, 8))}{one(('', number(1)))}.{one(('com', 'org', 'example.com', 'net', 'co.uk', 'de'))}", kind
        if kind == "PHONE":
            a, b, c = number(3), number(3), number(4)
            return one(("", "", "call ", "tel: ")), one((f"+{between(1, 99)} ({a}) {b}-{c}", f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+1-{a}-{b}-{c}", f"+{number(11)}", f"{a}.{b}.{c}")), kind
        if kind == "IP":
            return one(("", "", "host ")), ".".join(str(between(1, 255)) for _ in range(4)), kind
        if kind == "CARD":
            g = card(True)
            return one(("", "", "card ", "visa ")), one(("".join(g), "".join(g), " ".join(g), "-".join(g))), kind
        if kind == "ID":
            return one(("", "ssn ", "iban ")), one((f"{number(3)}-{number(2)}-{number(4)}", text_of(upper, 2) + number(2) + text_of(digits + upper, 4) + number(between(10, 18)))), kind
        value = one((long_hex(between(16, 40)), long_hex(40), long_hex(40).upper(), text_of(upper + digits, 16) + number(1), text_of(lower + upper + digits, between(16, 30)) + "aA1"))
        name = one(("password", "token", "secret", "api_key", "key", "passwd", "auth"))
        style = between(0, 5)
        if style <= 1:
            return f"{name}=", value, kind
        if style == 2:
            return f'{name} = "', value, kind
        if style == 3:
            return "", "AKIA" + text_of(upper + digits, 16), kind
        if style == 4:
            return f"{name}: ", value, kind
        return "", one(("sk-", "ghp_")) + text_of(lower + digits, 24) + "1", kind

    def plain() -> str:
        """A piece with digits or signs that is no entity."""
        if rng.random() < 0.15:
            return one(("", "", " ", "-")).join(card(False))
        return one((str(between(0, 999)), str(between(1900, 2100)), number(between(5, 9)), f"{between(1, 99)}.{number(2)}", f"${between(1, 9999)}", f"{between(1, 99)}%", f"{between(1, 12)}:{between(10, 59)}", f"{between(1990, 2030)}-{between(10, 12)}-{between(10, 28)}", f"{between(1, 28)}/{between(1, 12)}/{between(1990, 2030)}", f"x={between(0, 99)}", "=", "==", "@", f"v{between(1, 9)}.{between(0, 9)}.{between(0, 9)}", text_of(upper, between(12, 20)), f"{text_of(lower, 5)}{between(1, 9)}", f"{between(1, 20)}th", f"@{text_of(lower, 6)}", f"#{between(1, 999)}", f"{between(1, 9)}-{between(10, 99)}", number(between(10, 12)), f"{between(1, 5)}.{between(0, 9)}.{between(0, 9)}", f"n={between(0, 99)},", "a=b", f"{between(10, 99)}-{between(10, 99)}"))

    texts, gold = [], []
    for _ in range(documents):
        parts: list[str] = []
        places: list[tuple[int, int, str]] = []
        size = 0

        def add(x: str) -> None:
            nonlocal size
            parts.append(x)
            size += len(x)

        def put(before: str, x: str, label: str) -> None:
            add(before)
            places.append((size, size + len(x), label))
            add(x)
            add('"' if before.endswith('"') else "")

        again: tuple[str, str] | None = None
        for _ in range(between(4, 14)):
            for _ in range(between(1, 6)):
                add(text_of(lower, between(2, 9)) + one(("", "", "", ".", ",")) + " ")
            roll = rng.random()
            if roll < 0.40:
                before, x, label = entity()
                put(before, x, label)
                again = (x, label)
                add(one(("", "", "", ".", ",", "!!", "###", "$$$", "%%%", "&&&", "***")) + " ")
            elif roll < 0.55 and again:  # the same content once more, without what led to it
                put("", *again)
                add(one(("", ".")) + " ")
            elif roll < 0.9:
                x = plain()
                add(x + one(("", "", ".", ",")) + " ")
                if rng.random() < 0.2:
                    add(text_of(lower, 4) + " " + x + " ")
        texts.append("".join(parts).rstrip())
        gold.append(places)
    return texts, gold


if __name__ == "__main__":
    FITTED.write_text(json.dumps({"labels": LABELS, "features": FEATURES, **{n: np.round(v, 5).tolist() for n, v in train().items()}}) + "\n")
