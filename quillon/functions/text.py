"""Columns over texts: tokens, n-grams, sentences, white space, bytes. All are Catalyst built-ins."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once: an expression inside a lambda is else worked out for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tokens(text: Column | str, unicode_space: bool = False) -> Column:
    """Pieces between white space. Null for null; none for an empty text."""
    return F.regexp_extract_all(_col(text), F.lit(r"(?U)\S+" if unicode_space else r"\S+"), F.lit(0))


def split_on(text: Column | str, sep: str = " ") -> Column:
    """All pieces between separators, empty ones too; an empty text is one empty piece."""
    return F.split(_col(text), re.escape(sep) if sep else "", -1)


def drop_short(text: Column | str, sep: str = " ", n: int | None = 1) -> Column:
    """The text without its pieces of at most ``n`` characters; None leaves it as it is."""
    if n is None:
        return _col(text)
    return F.array_join(F.filter(split_on(text, sep), lambda w: F.length(w) > n), sep)


def drop_words(toks: Column | str, words) -> Column:
    """Tokens without those whose upper case is among ``words``."""
    own = sorted({w.upper() for w in words})
    return F.filter(_col(toks), lambda w: ~F.upper(w).isin(*own)) if own else _col(toks)


def one_line(text: Column | str) -> Column:
    """White space, Unicode's too, collapsed into single spaces."""
    return F.regexp_replace(_col(text), r"(?U)\s+", " ")


def ngrams(toks: Column | str, n: int = 2) -> Column:
    """Arrays of ``n`` neighbouring tokens, in order; none where there are fewer tokens."""
    return let(_col(toks), lambda t: F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - n + 1, F.lit(1))), lambda i: F.slice(t, i, n))).otherwise(F.array().cast("array<array<string>>")))


def sentences(text: Column | str, ends: str = r"[.\n]") -> Column:
    """Trimmed pieces between sentence ends, without empty ones."""
    return F.filter(F.transform(F.split(_col(text), ends), lambda s: F.trim(s)), lambda s: s != "")


def document_part(sentence_id: Column | str) -> Column:
    """The document in ``{doc}_{number}``: all before the last ``_``; null where there is none."""
    own = _col(sentence_id)
    return F.when(own.rlike(r"(?s)^.*_[^_]*$"), F.regexp_extract(own, r"(?s)^(.*)_[^_]*$", 1))


def sentence_number(sentence_id: Column | str) -> Column:
    """The number in ``{doc}_{number}``; null where it isn't one."""
    return F.regexp_extract(_col(sentence_id), r"(?s)^.*_([0-9]+)$", 1).try_cast("int")


def first_code(text: Column | str) -> Column:
    """The code of the first character, a deterministic hash of little worth; null for an empty text."""
    own = _col(text)
    return F.when(F.length(own) > 0, F.ascii(own))


def from_base64(text: Column | str) -> Column:
    return F.unbase64(_col(text))


def similarity_weight(rank: Column | str) -> Column:
    """1 / ln(2 + rank), for ranks from 0."""
    return 1 / F.log(2 + _col(rank))
