"""Documents to sentences and tokens: built-in splitting, and a pluggable annotator for everything else."""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.functions.lexicons import NEGATIVE_WORDS, POSITIVE_WORDS

NESTED = "array<struct<text:string,sentiment:string,words:array<struct<text:string,lemma:string,pos:string,ner:string,at:int>>>>"


def split_sentences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ends: str = r"[.\n]") -> DataFrame:
    """``id, sent_no INT, sent_id STRING, text``: a row for each sentence, ``sent_id`` being ``{doc}_{number}``."""
    own = df.select(F.col(id_col), F.posexplode(T.sentences(text_col, ends)).alias("sent_no", "text"))
    return own.select(id_col, "sent_no", F.concat(F.col(id_col).cast("string"), F.lit("_"), F.col("sent_no").cast("string")).alias("sent_id"), "text")


def word_tokens(text: Column | str) -> Column:
    """Words, of letters, marks, numbers and ``_``, and single signs."""
    return F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(r"[\p{L}\p{M}\p{N}\p{Pc}]+|[^\p{L}\p{M}\p{N}\p{Pc}\p{Z}\p{Cc}]"), F.lit(0))


def tokenized(df: DataFrame, text_col: str = "text", sep: str = " ") -> DataFrame:
    """Texts with a separator between all words and signs."""
    return df.withColumn(text_col, F.array_join(word_tokens(text_col), sep))


def annotate(df: DataFrame, annotator: Callable[[], Callable[[str], list[tuple[str, str]]]] | None = None, id_col: str = "doc_id", text_col: str = "text", on_error: str = "ignore") -> DataFrame:
    """``sent_id, text, error``: the annotated sentences of each document.

    ``annotator`` is called once for each Python worker and gives a function from a text to its
    sentences (text, error or ""). Without one, sentences are split and words are tagged by shape in the JVM.
    A failure gives the one row ``{doc}_0`` with an empty text and the error, or is raised.
    """
    if on_error not in ("ignore", "raise"):
        raise ValueError("on_error: ignore or raise")
    if annotator is None:
        rows = split_sentences(df, id_col, text_col)
        tagged = F.array_join(F.transform(word_tokens("text"), lambda w: F.concat(w, F.lit("[POS:"), shape_tag(w), F.lit("]"))), " ")
        return rows.select("sent_id", tagged.alias("text"), F.lit(None).cast("string").alias("error"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = annotator()
        for frame in frames:
            out = []
            for doc, text in zip(frame["id"], frame["text"]):
                try:
                    out += [(f"{doc}_{k}", s, None) for k, s in enumerate(own(text or ""))]
                except Exception as e:
                    if on_error == "raise":
                        raise
                    out.append((f"{doc}_0", "", f"{type(e).__name__}: {e}"))
            if out:
                yield pd.DataFrame(out, columns=["sent_id", "text", "error"])

    return df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "sent_id string, text string, error string")


def shape_tag(word: Column) -> Column:
    """A part-of-speech tag by a word's shape alone: what an annotator would replace."""
    return F.when(word.rlike(r"^\p{N}+$"), "CD").when(word.rlike(r"^\p{P}$"), ".").when(word.rlike(r"^\p{Lu}"), "NNP").when(word.rlike(r"ing$"), "VBG").when(word.rlike(r"ly$"), "RB").when(word.rlike(r"^[^\p{L}\p{N}_]"), "SYM").otherwise("NN")


#: Endings that a base form has not, in order: (ending, least letters before it, what takes its place).
LEMMA_RULES = (("sses", 1, "ss"), ("ies", 2, "y"), ("xes", 1, "x"), ("ches", 1, "ch"), ("shes", 1, "sh"), ("ied", 2, "y"), ("ing", 3, ""), ("ed", 3, ""), ("s", 3, ""))


def lemma(word: Column) -> Column:
    """A base form by English endings: plurals, ``-ing`` and ``-ed`` go from words of letters, ``-ss``, ``-us`` and ``-is`` stay. Lower case."""

    def base(low: Column) -> Column:
        out = None
        for last in sorted({ending[-1] for ending, _, _ in LEMMA_RULES}):
            own = None
            for ending, least, instead in LEMMA_RULES:
                if ending[-1] == last:
                    pattern = rf"^[a-z]{{{least - 1},}}" + ("[b-hj-rtv-z]" if ending == "s" else "[a-z]") + ending + "$"
                    value = F.concat(F.substring(low, F.lit(1), F.length(low) - len(ending)), F.lit(instead))
                    own = (F if own is None else own).when(low.rlike(pattern), value)
            # most words have none of the last letters, and are matched against no pattern
            out = (F if out is None else out).when(low.endswith(last), own.otherwise(low))
        return out.otherwise(low)

    return T.let(F.lower(word), base)


def entity_tag(word: Column, before: Column) -> Column:
    """An entity tag by a word's shape and the word before it: numbers, percentages, money, years, and capitalised words inside a sentence."""
    number = word.rlike(r"^\p{Nd}+$")
    return F.when(number & before.isin("$", "€", "£"), "MONEY").when(word.rlike(r"^(1[89]|20)\p{Nd}{2}$"), "DATE").when(number, "NUMBER").when(word == "%", "PERCENT").when((before != "") & word.rlike(r"^\p{Lu}\p{Ll}+$"), "MISC").otherwise("O")


def tone(words: Column) -> Column:
    """``Positive``, ``Negative`` or ``Neutral``: of words of either kind, which there are more of."""

    def of(low: Column) -> Column:
        among = lambda own: F.size(F.filter(low, lambda w: w.isin(*sorted(own))))
        return T.let(among(POSITIVE_WORDS) - among(NEGATIVE_WORDS), lambda score: F.when(score > 0, "Positive").when(score < 0, "Negative").otherwise("Neutral"))

    some = sorted(POSITIVE_WORDS | NEGATIVE_WORDS)
    # most sentences have no such word
    return T.let(F.filter(F.transform(words, F.lower), lambda w: w.isin(*some)), lambda low: F.when(F.size(low) > 0, of(low)).otherwise(F.lit("Neutral")))


#: Attributes of a sentence and of a word, as NESTED has them.
SENTENCE, WORD = ("text", "sentiment", "words"), ("text", "lemma", "pos", "ner", "at")
_PLAIN = r"^\p{Ll}+\z"


def nested(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ends: str = r"[.\n]", attributes: Collection[str] = SENTENCE, word_attributes: Collection[str] = WORD) -> DataFrame:
    """``id, sentences``: each document as sentences of words (``NESTED``), by rules in the JVM: splitting, endings, shapes, word lists.

    Only ``attributes`` of sentences and ``word_attributes`` of words are worked out and given: an engine doesn't drop what
    a lambda makes and nobody reads. A model's judgement needs an annotator (``annotate``).
    """
    if unknown := (set(attributes) - set(SENTENCE)) | (set(word_attributes) - set(WORD)):
        raise ValueError(f"unknown attributes: {sorted(unknown)}")
    sent, word = [a for a in SENTENCE if a in attributes], [a for a in WORD if a in word_attributes]
    kinds = {"at": "int"}

    def tagged(w: Column, x: Column, i: Column) -> Column:
        # a word of lower-case letters alone has no entity, and a tag by its ending
        plain = {"text": x, "lemma": lemma(x), "pos": F.when(x.endswith("ing"), "VBG").when(x.endswith("ly"), "RB").otherwise("NN"), "ner": F.lit("O"), "at": i}
        other = plain | {"pos": shape_tag(x), "ner": entity_tag(x, F.when(i > 0, F.get(w, i - 1)).otherwise(F.lit("")))}
        struct = lambda own: F.struct(*[own[a].alias(a) for a in word])
        return F.when(x.rlike(_PLAIN), struct(plain)).otherwise(struct(other)) if {"pos", "ner"} & set(word) else struct(plain)

    def sentence(s: Column) -> Column:
        def of(w: Column) -> Column:
            own = {"text": s, "sentiment": tone(w) if w is not None else None, "words": F.transform(w, lambda x, i: tagged(w, x, i)) if w is not None else None}
            return F.struct(*[own[a].alias(a) for a in sent])

        return T.let(word_tokens(s), of) if set(sent) != {"text"} else of(None)

    kind = {"text": "string", "sentiment": "string", "words": "array<struct<" + ",".join(f"{a}:{kinds.get(a, 'string')}" for a in word) + ">>"}
    schema = "array<struct<" + ",".join(f"{a}:{kind[a]}" for a in sent) + ">>"
    return df.select(id_col, F.transform(T.sentences(text_col, ends), sentence).cast(schema).alias("sentences"))


def sentence_attribute(df: DataFrame, name: str, id_col: str = "doc_id") -> DataFrame:
    """``id, values ARRAY``: one attribute of each sentence of a nested frame."""
    return df.select(id_col, F.transform("sentences", lambda s: s[name]).alias("values"))


def word_attribute(df: DataFrame, name: str, id_col: str = "doc_id") -> DataFrame:
    """``id, values ARRAY<ARRAY>``: one attribute of each word of each sentence."""
    return df.select(id_col, F.transform("sentences", lambda s: F.transform(s["words"], lambda w: w[name])).alias("values"))


def dump_sentences(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id, sent_no INT, words_json``: each sentence's words as JSON."""
    return df.select(id_col, F.posexplode("sentences").alias("sent_no", "s")).select(id_col, "sent_no", F.to_json("s.words").alias("words_json"))
