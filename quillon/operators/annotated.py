"""Annotated lines: parsing, rendering and rule-based cleaning, in built-in expressions; whole frames are cleaned in batches.

A line holds tokens between spaces; a token holds parts between ``[SEP]``; a part is
``[NER:x]text[POS:y]`` with either label optional; one token ``[SENTIMENT:z]`` can lead.
Parsed, a line is ``ARRAY<ARRAY<STRUCT<ner, pos, original_text>>>``.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Collection, Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quillon.functions import text as T
from quillon.functions.lexicons import PUNCTUATION_TAGS, STOPWORDS

ALL = "all"
_COMPOSITION = {
    "contains_alphabet_only": r"^\p{L}+$",
    "contains_alphabet_or_number_only": r"^[\p{L}\p{N}]+$",
    "contains_number_only": r"^\p{N}+$",
    "contains_alphabet": r"\p{L}",
    "contains_number": r"\p{N}",
    "contains_alphabet_or_number": r"[\p{L}\p{N}]",
}
#: What each option takes away: (the tag, the text).
_TAKES = {"removes_tags": (True, False), "removes_original_text": (False, True), "removes_tags_and_original_text": (True, True)}


@dataclass(frozen=True)
class Rules:
    """How lines are parsed, which fields of which tokens go, and how the rest is joined."""

    lower_case: bool = False
    token_sep: str = " "
    part_sep: str = "[SEP]"
    ner_label: str = "NER"
    pos_label: str = "POS"
    sentiment_label: str = "SENTIMENT"
    composition: str | None = None
    most_ner_tags: int | None = None
    punctuation: Collection[str] = ()
    stopwords: Collection[str] = ()
    longer_than: int | None = None
    ner: Mapping[str, str | Collection[str]] = field(default_factory=dict)
    pos: Mapping[str, str | Collection[str]] = field(default_factory=dict)
    joined_parts: str = "[SEP]"
    joined_tokens: str = " "

    def __post_init__(self) -> None:
        if self.composition is not None and self.composition not in _COMPOSITION:
            raise ValueError(f"composition must be one of {sorted(_COMPOSITION)}")
        if isinstance(self.longer_than, bool) or isinstance(self.most_ner_tags, bool):
            raise ValueError("a number, not a boolean")
        for options in (self.ner, self.pos):
            if unknown := set(options) - set(_TAKES):
                raise ValueError(f"unknown options: {sorted(unknown)}")


def _cased(text: str, rules: Rules) -> str:
    return text.lower() if rules.lower_case else text


def _raw_tokens(line: Column | str, rules: Rules) -> Column:
    own = F.trim(F.col(line) if isinstance(line, str) else line)
    return T.split_on(F.lower(own) if rules.lower_case else own, _cased(rules.token_sep, rules))


def _sentiment_pattern(rules: Rules) -> str:
    return rf"(?is)^\[{re.escape(rules.sentiment_label)}:(.+?)\]$"


def sentiment(line: Column | str, rules: Rules = Rules()) -> Column:
    """The label of the first token that is one; an empty text if there is none."""
    pattern, mark = _sentiment_pattern(rules), f"[{rules.sentiment_label}:".lower()
    hits = F.filter(_raw_tokens(line, rules), lambda t: t.startswith("[") & F.lower(t).startswith(mark) & t.rlike(pattern))
    found = F.coalesce(F.regexp_extract(F.try_element_at(hits, F.lit(1)), pattern, 1), F.lit(""))
    own = F.col(line) if isinstance(line, str) else line
    if sep := _cased(rules.token_sep, rules):  # mostly it is the first token, and the others needn't be looked at
        first = F.substring_index(F.lower(F.trim(own)) if rules.lower_case else F.trim(own), sep, 1)
        found = F.when(first.startswith("[") & F.lower(first).startswith(mark) & first.rlike(pattern), F.regexp_extract(first, pattern, 1)).otherwise(found)
    # most lines have no such mark, and one search of the line tells
    return F.when(F.contains(F.lower(own), F.lit(mark)), found).otherwise(F.lit(""))


def parse(line: Column | str, rules: Rules = Rules()) -> Column:
    """The line's tokens without the first sentiment token."""
    pattern, mark = _sentiment_pattern(rules), f"[{rules.sentiment_label}:".lower()
    is_one = lambda x: x.startswith("[") & F.lower(x).startswith(mark) & x.rlike(pattern)
    without = lambda t: T.let(F.struct(t.alias("t"), F.array_position(F.transform(t, is_one), True).alias("at")), lambda v: F.filter(v["t"], lambda x, i: i + 1 != v["at"]))
    own = F.col(line) if isinstance(line, str) else line
    raw = _raw_tokens(line, rules)
    toks = F.when(F.contains(F.lower(own), F.lit(mark)), T.let(raw, without)).otherwise(raw)
    ner_pattern = rf"(?is)^\[{re.escape(rules.ner_label)}:(.+?)\]"
    # what follows the last tag: found by one pattern, the rest by its length
    pos_pattern = rf"(?is)^.*(\[{re.escape(rules.pos_label)}:.+?\]$)"
    skip = len(rules.pos_label) + 2

    def part(p: Column) -> Column:
        def tail(rest: Column) -> Column:
            def tagged(v: Column) -> Column:
                tag, rest = v["tag"], v["rest"]
                some = tag != ""
                # a line break behind the tag goes with it
                return F.struct(
                    v["ner"].alias("ner"),
                    F.when(some, F.substring(tag, skip + 1, F.length(tag) - skip - 1)).otherwise(F.lit("")).alias("pos"),
                    F.when(some, F.substring(rest, F.lit(1), F.length(F.regexp_replace(rest, "(?:\r\n|[\n\r\u0085\u2028\u2029])\\z", "")) - F.length(tag))).otherwise(rest).alias("original_text"),
                )

            return T.let(F.struct(rest["ner"].alias("ner"), rest["rest"].alias("rest"), F.when(F.contains(rest["rest"], F.lit("[")), F.regexp_extract(rest["rest"], pos_pattern, 1)).otherwise(F.lit("")).alias("tag")), tagged)

        bare = F.struct(F.lit("").alias("ner"), p.alias("rest"))
        marked = F.struct(F.regexp_extract(p, ner_pattern, 1).alias("ner"), F.regexp_replace(p, ner_pattern, "").alias("rest"))
        return T.let(F.when(p.startswith("["), marked).otherwise(bare), tail)

    split = lambda t: F.when(F.contains(t, F.lit(sep)), T.split_on(t, sep)).otherwise(F.array(t)) if sep else T.split_on(t, sep)
    sep = _cased(rules.part_sep, rules)
    return F.transform(toks, lambda t: F.transform(split(t), part))


def render(tokens: Column | str, rules: Rules = Rules()) -> Column:
    """A line of parsed tokens; fields that are empty leave nothing, nor do empty parts and tokens."""
    own = F.col(tokens) if isinstance(tokens, str) else tokens
    tag = lambda label, x: F.when(x != "", F.concat(F.lit(_cased(f"[{label}:", rules)), F.lower(x) if rules.lower_case else x, F.lit("]"))).otherwise(F.lit(""))
    part = lambda p: F.concat(tag("NER", p["ner"]), p["original_text"], tag("POS", p["pos"]))
    full = lambda xs: F.filter(xs, lambda x: x != "")
    return F.array_join(full(F.transform(own, lambda t: F.array_join(full(F.transform(t, part)), rules.joined_parts))), rules.joined_tokens)


def clean_tokens(tokens: Column | str, rules: Rules) -> Column:
    """Parsed tokens with the fields that the rules take away emptied. All checks hold together, in any order."""
    own = F.col(tokens) if isinstance(tokens, str) else tokens

    def token(parts: Column) -> Column:
        return T.let(F.array_join(F.transform(parts, lambda p: p["original_text"]), ""), lambda full: T.let(whole(parts, full), lambda keep: fields(parts, keep)))

    def whole(parts: Column, full: Column) -> Column:
        keep = F.lit(True)
        if rules.composition:
            keep &= full.rlike(_COMPOSITION[rules.composition])
        if rules.longer_than is not None:
            keep &= F.length(full) > rules.longer_than
        gone = sorted({w.upper() for w in (*rules.punctuation, *rules.stopwords)})
        if gone:  # of several parts, none is looked up
            keep &= (F.size(parts) != 1) | ~F.upper(full).isin(*gone)
        return keep

    def fields(parts: Column, keep: Column) -> Column:
        keep_ner, keep_text, keep_pos = [], [], []

        def hit(p: Column, name: str, which: str | Collection[str]) -> Column:
            return p[name] != "" if which == ALL else (F.upper(p[name]).isin(*sorted({w.upper() for w in which})) if which else F.lit(False))

        if rules.most_ner_tags is not None:
            keep_ner.append(lambda p, i: F.size(F.filter(F.slice(parts, 1, i), lambda q: q["ner"] != "")) < rules.most_ner_tags)
        for option, which in rules.ner.items():
            # a hit speaks for its own part and for all after it
            free = lambda p, i, which=which: ~F.exists(F.slice(parts, 1, i + 1), lambda q: hit(q, "ner", which))
            tag, text = _TAKES[option]
            keep_ner += [free] * tag
            keep_text += [free] * text
        for option, which in rules.pos.items():
            free = lambda p, i, which=which: ~hit(p, "pos", which)
            tag, text = _TAKES[option]
            keep_pos += [free] * tag
            keep_text += [free] * text

        def part(p: Column, i: Column) -> Column:
            def value(name: str, checks: list) -> Column:
                ok = keep
                for c in checks:
                    ok = ok & c(p, i)
                return F.when(ok, p[name]).otherwise(F.lit("")).alias(name)

            return F.struct(value("ner", keep_ner), value("pos", keep_pos), value("original_text", keep_text))

        return F.transform(parts, part)

    return F.transform(own, token)


def clean_line(line: Column | str, rules: Rules) -> Column:
    """Parse, clean and render in one expression."""
    return render(clean_tokens(parse(line, rules), rules), rules)


#: Where Java ends a text: there, or before a last line break.
_END = "(?=\\Z|\r\n\\Z|(?<!\r)\n\\Z|[\r\x85\u2028\u2029]\\Z)"
_BREAK = re.compile("(?:\r\n|[\n\r\x85\u2028\u2029])\\Z")
#: Signs that are letters or numbers, or not, in every version of Unicode that an engine may have: lines with others are cleaned by expressions.
_SETTLED = re.compile("[\0-\u0377\u0400-\u0523\u2000-\u206f\u20a0-\u20b5\u2190-\u23e7\u3000-\u303f\u3041-\u3096\u30a0-\u30ff\u4e00-\u9fa5\uac00-\ud7a3\uff01-\uff5e\ufffd\U0001f300-\U0001f9ff]*+\\Z")
#: Tags and rows of tags of which a cleaner remembers what they lead to.
KEPT = 1 << 14


def _is(text: str, kinds: str) -> bool:
    return all(unicodedata.category(c)[0] in kinds for c in text)


_COMPOSED: dict[str, Callable[[str], bool]] = {
    "contains_alphabet_only": lambda x: x.isalpha() or x[-1:].isspace() and _BREAK.sub("", x).isalpha(),
    "contains_alphabet_or_number_only": lambda x: (x := _BREAK.sub("", x)) != "" and _is(x, "LN"),
    "contains_number_only": lambda x: (x := _BREAK.sub("", x)) != "" and _is(x, "N"),
    "contains_alphabet": lambda x: any(c.isalpha() for c in x),
    "contains_number": lambda x: any(_is(c, "N") for c in x),
    "contains_alphabet_or_number": lambda x: any(_is(c, "LN") for c in x),
}


def line_cleaner(rules: Rules, longer_than: int | None = None) -> Callable[[str], str]:
    """``clean_line`` in Python, for a line in lower case where the rules say so: what its tags lead to is worked out once for all tokens that have the same.

    Of the result's pieces between ``joined_tokens``, those of at most ``longer_than`` characters are dropped.
    """
    flags = re.I | re.S | re.A  # of letters without case signs Java takes those of ASCII alone
    tone = re.compile(rf"\A\[{re.escape(rules.sentiment_label)}:(.+?)\]" + _END, flags)
    ner = re.compile(rf"\A\[{re.escape(rules.ner_label)}:(.+?)\]", flags)
    pos = re.compile(rf"\A.*(\[{re.escape(rules.pos_label)}:.+?\]{_END})", flags)
    mark = re.compile(re.escape(f"[{rules.sentiment_label}:"), flags)
    token_sep, part_sep = _cased(rules.token_sep, rules), _cased(rules.part_sep, rules)
    ner_tag, pos_tag, skip = _cased("[NER:", rules), _cased("[POS:", rules), len(rules.pos_label) + 2
    composed = _COMPOSED[rules.composition] if rules.composition else None
    gone, least = {w.upper() for w in (*rules.punctuation, *rules.stopwords)}, -1 if rules.longer_than is None else rules.longer_than
    heads: dict[str, str] = {}
    tails: dict[str, str] = {}
    plans: dict[tuple, list[tuple[str, str, bool]]] = {}

    def hits(which: str | Collection[str]) -> Callable[[str], bool]:
        own = which if which == ALL else {w.upper() for w in which}
        return lambda x: x != "" if which == ALL else x.upper() in own

    by_ner = [(hits(which), *_TAKES[option]) for option, which in rules.ner.items()]
    by_pos = [(hits(which), *_TAKES[option]) for option, which in rules.pos.items()]

    def known(table: dict, key, value):
        if len(table) >= KEPT:
            table.clear()
        table[key] = value
        return value

    def part(p: str) -> tuple[str, str, str]:
        """(ner, pos, text) of a part with a bracket."""
        label = tag = ""
        if p[0] == "[" and (end := p.find("]") + 1):
            # up to the first bracket that closes, unless nothing is before it
            head = p[:end]
            if (label := heads.get(head)) is None:
                label = known(heads, head, m[1] if (m := ner.match(head)) else "")
            if label:
                p = p[end:]
            elif m := ner.match(p):
                label, p = m[1], p[m.end() :]
        if p[-1:] == "]":
            begin = p.rfind("[")
            if begin < 0:
                return label, "", p
            tail = p[begin:]
            if (tag := tails.get(tail)) is None:
                tag = known(tails, tail, tail[skip:-1] if pos.match(tail) else "")
            if tag:
                return label, tag, p[:begin]
        elif "[" not in p or not _BREAK.search(p):
            return label, "", p
        if m := pos.match(p):
            broken = _BREAK.sub("", p)
            return label, m[1][skip:-1], broken[: max(len(broken) - len(m[1]), 0)]
        return label, "", p

    def plan(key: tuple) -> list[tuple[str, str, bool]]:
        """(label before, label behind, whether the text stays) of each of a token's parts by their (ner, pos)."""
        out, seen, over = [], 0, [False] * len(by_ner)
        for label, tag in key:
            keep_ner, keep_pos, keep_text = rules.most_ner_tags is None or seen < rules.most_ner_tags, True, True
            seen += label != ""
            for i, (hit, of_tag, of_text) in enumerate(by_ner):
                over[i] = over[i] or hit(label)  # for its own part and all after it
                if over[i]:
                    keep_ner, keep_text = keep_ner and not of_tag, keep_text and not of_text
            for hit, of_tag, of_text in by_pos:
                if hit(tag):
                    keep_pos, keep_text = keep_pos and not of_tag, keep_text and not of_text
            label, tag = (label.lower(), tag.lower()) if rules.lower_case else (label, tag)
            out.append((f"{ner_tag}{label}]" if keep_ner and label else "", f"{pos_tag}{tag}]" if keep_pos and tag else "", keep_text))
        return known(plans, key, out)

    def token(t: str) -> str:
        if part_sep in t:
            parts = [part(p) if "[" in p else ("", "", p) for p in t.split(part_sep)]
            full = "".join([p[2] for p in parts])
            if len(full) <= least or composed and not composed(full):
                return ""
            key = tuple([p[:2] for p in parts])
            own = [before + p[2] + behind if keep else before + behind for (before, behind, keep), p in zip(plans.get(key) or plan(key), parts)]
            return rules.joined_parts.join([x for x in own if x])
        label, tag, text = part(t) if "[" in t else ("", "", t)
        if len(text) <= least or composed and not composed(text) or gone and text.upper() in gone:
            return ""
        key = ((label, tag),)
        before, behind, keep = (plans.get(key) or plan(key))[0]
        return before + text + behind if keep else before + behind

    def line(text: str) -> str:
        toks = text.strip(" ").split(token_sep)
        if mark.search(text):
            first = next((i for i, t in enumerate(toks) if t.startswith("[") and tone.match(t)), None)
            if first is not None:
                del toks[first]
        out = rules.joined_tokens.join([x for t in toks if (x := token(t))])
        return out if longer_than is None else rules.joined_tokens.join([w for w in out.split(rules.joined_tokens) if len(w) > longer_than])

    return line


def _clean_in_batches(line: Column, rules: Rules, longer_than: int | None = None) -> Column:
    """``clean_line`` and ``drop_short``: by batches of lines, and by expressions where signs are such that Python and the JVM may differ."""
    exact = T.drop_short(clean_line(line, rules), rules.joined_tokens, longer_than)
    if "" in (rules.token_sep, rules.part_sep, rules.joined_tokens):
        return exact

    @pandas_udf("string")
    def cleaned(lines: pd.Series) -> pd.Series:
        own = line_cleaner(rules, longer_than)
        return pd.Series([own(x) if x is not None and (x.isascii() or _SETTLED.match(x)) else None for x in lines], dtype=object)

    return F.coalesce(cleaned(F.lower(line) if rules.lower_case else line), exact)


#: Entities become their tags alone, tags of parts of speech go, punctuation goes; parts are joined by ``_``.
CORPUS_RULES = Rules(ner={"removes_original_text": ALL}, pos={"removes_tags": ALL, "removes_tags_and_original_text": tuple(sorted(PUNCTUATION_TAGS))}, joined_parts="_")
#: Words of letters only, without stop words and single letters; tags go, texts stay.
NGRAM_RULES = Rules(lower_case=True, composition="contains_alphabet_only", stopwords=tuple(sorted(STOPWORDS)), longer_than=1, ner={"removes_tags": ALL}, pos={"removes_tags": ALL}, joined_parts=" ")


def clean(df: DataFrame, rules: Rules = CORPUS_RULES, line_col: str = "text", with_sentiment: bool = False) -> DataFrame:
    """The frame with its annotated lines cleaned in place; ``sentiment`` in one more column."""
    out = df.withColumn("sentiment", sentiment(line_col, rules)) if with_sentiment else df
    return out.withColumn(line_col, _clean_in_batches(F.col(line_col), rules))


def preprocess(df: DataFrame, rules: Rules = NGRAM_RULES, line_col: str = "text", collapse: bool = True, piece_longer_than: int | None = 1) -> DataFrame:
    """Lines for n-gram scores: white space collapsed to the token separator, cleaned, short pieces dropped."""
    own = F.regexp_replace(F.col(line_col), r"(?U)\s+", rules.token_sep.replace("\\", "\\\\").replace("$", "\\$")) if collapse else F.col(line_col)
    return df.withColumn(line_col, _clean_in_batches(own, rules, piece_longer_than))


def edge_sources(edges: Column | str) -> Column:
    """The places that edges ``STRUCT<start, end>`` lead on from: each of start .. end - 1, in order."""
    own = F.col(edges) if isinstance(edges, str) else edges
    own = F.filter(own, lambda e: e["start"] < e["end"])
    return F.array_sort(F.array_distinct(F.flatten(F.transform(own, lambda e: F.sequence(e["start"], e["end"] - 1)))))


def dependency_edges(dependencies: Column | str, first_token: Column | str, kinds: Collection[str] = ("mwe", "compound", "compound:prt")) -> Column:
    """Edges between the parts of multi-word expressions: of ``STRUCT<source, target, dep>`` counted from 1, to places counted from the document's first token."""
    deps, base = (F.col(x) if isinstance(x, str) else x for x in (dependencies, first_token))
    return F.transform(F.filter(deps, lambda d: d["dep"].isin(*sorted(kinds))), lambda d: F.struct((F.least(d["source"], d["target"]) - 1 + base).alias("start"), (F.greatest(d["source"], d["target"]) - 1 + base).alias("end")))


def mention_edges(mentions: Column | str) -> Column:
    """Edges inside entities: of ``STRUCT<start, end, type>``, the end excluded, to places of first and last token."""
    own = F.col(mentions) if isinstance(mentions, str) else mentions
    return F.transform(own, lambda m: F.struct(F.least(m["start"], m["end"]).alias("start"), (F.greatest(m["start"], m["end"]) - 1).alias("end")))


def render_sentence(tokens: Column | str, joins: Column | str, mentions: Column | str | None = None, lemma: bool = True, pos: bool = True, sentiment: Column | str | None = None, rules: Rules = Rules()) -> Column:
    """An annotated line of ``STRUCT<at, text, lemma, pos, ner>`` tokens.

    A token whose place is among ``joins`` is followed by the part separator, any other one by
    the token separator, the last too. The k-th token that begins a mention and is itself
    an entity takes the type of the k-th mention.
    """
    toks, joined = (F.col(x) if isinstance(x, str) else x for x in (tokens, joins))
    mentioned = F.col(mentions) if isinstance(mentions, str) else mentions
    own = F.col(sentiment) if isinstance(sentiment, str) else sentiment

    def text_of(t: Column, glue: Column) -> Column:
        tag = F.concat(F.lit(f"[{rules.pos_label}:"), t["pos"], F.lit("]")) if pos else F.lit("")
        return F.concat(t["lemma"] if lemma else t["text"], tag, F.when(F.array_contains(glue, t["at"]), F.lit(rules.part_sep)).otherwise(F.lit(rules.token_sep)))

    def with_types(v: Column, first: Column) -> Column:
        """The line, the places of the tokens that begin a mention being known."""

        def one(t: Column, i: Column) -> Column:
            k = F.array_position(first, i)
            label = F.when(k > 0, F.concat(F.lit(f"[{rules.ner_label}:"), F.coalesce(F.get(v["spans"], (k - 1).cast("int"))["type"], F.lit("")), F.lit("]"))).otherwise(F.lit(""))
            return F.concat(label, text_of(t, v["glue"]))

        return F.array_join(F.transform(v["toks"], one), "")

    # columns that the plan has folded into this expression are worked out once a line, not once a token
    if mentioned is None:
        line = T.let(F.struct(toks.alias("toks"), joined.alias("glue")), lambda v: F.array_join(F.transform(v["toks"], lambda t: text_of(t, v["glue"])), ""))
    else:
        begin = lambda v: F.transform(v["spans"], lambda m: F.least(m["start"], m["end"]))
        places = lambda v, starts: F.filter(F.transform(v["toks"], lambda t, i: F.when(F.array_contains(starts, t["at"]) & (t["ner"] != "O"), i)), lambda i: i.isNotNull())
        line = T.let(F.struct(toks.alias("toks"), joined.alias("glue"), mentioned.alias("spans")), lambda v: T.let(begin(v), lambda starts: T.let(places(v, starts), lambda first: with_types(v, first))))
    if sentiment is None:
        return line
    return F.concat(F.lit(f"[{rules.sentiment_label}:"), own, F.lit("]" + rules.token_sep), line)
