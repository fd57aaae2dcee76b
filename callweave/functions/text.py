"""Column expressions over utterance and document text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from callweave import constants as C
from callweave.functions.clean import trim_blank
from callweave.functions.vec import let

WORD = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_']*[\p{L}\p{N}_])?"
DEVANAGARI = "[ऀ-ॿ]"
TAMIL = "[஀-௿]"
TELUGU = "[ఀ-౿]"
ARABIC = "[؀-ۿ]"
ANY_INDIC = "[ऀ-ॿ஀-௿ఀ-౿]"


def alternation(words) -> str:
    return "|".join(re.escape(w) for w in words)


def word_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("bigint")


def greets(c: Column, brands=(), whole_word: bool = False) -> Column:
    """Does the text hold a greeting token?  Tokens match inside words unless ``whole_word``."""
    pattern = alternation([*brands, *C.GREETING_TOKENS])
    if whole_word:
        pattern = rf"(?<![\p{{L}}\p{{N}}_])(?:{pattern})(?![\p{{L}}\p{{N}}_])"
    return F.coalesce(F.lower(c).rlike(pattern), F.lit(False))


def interrogatives(c: Column) -> Column:
    """Occurrences of question words, each token counted on its own."""
    low = F.lower(F.coalesce(c, F.lit("")))
    total = F.lit(0)
    for token in C.INTERROGATIVE_TOKENS:
        gone = F.length(low) - F.length(F.replace(low, F.lit(token), F.lit("")))
        total = total + F.floor(gone / len(token))
    return total.cast("bigint")


def detect_language(c: Column) -> Column:
    """Script and word-list language label of one text."""

    def roman(tokens):
        ratio = F.size(F.filter(tokens, lambda t: t.isin(C.ROMAN_HINDI_TOKENS))) / F.size(tokens)
        return (
            F.when(ratio >= 0.20, F.when(F.exists(tokens, lambda t: F.length(t) > 2), F.lit("hi-en")).otherwise(F.lit("hi-roman")))
            .when(ratio >= 0.10, F.lit("hi-en"))
            .otherwise(F.lit("en")))

    words = F.filter(F.split(F.lower(c), "[^a-z]+"), lambda t: t != "")
    latin = F.when(c.rlike("[A-Za-z]"), let(words, roman)).otherwise(F.lit("other"))
    indic = (
        F.when(c.rlike(TAMIL), F.lit("ta"))
        .when(c.rlike(TELUGU), F.lit("te"))
        .when(~c.rlike(DEVANAGARI), latin)
        .when(c.rlike("[A-Za-z]"), F.lit("hi-en"))
        .otherwise(F.lit("hi")))
    return (
        F.when(c.isNull() | (trim_blank(c) == ""), F.lit("other"))
        .when(c.rlike(ANY_INDIC), indic)  # one scan settles the common case
        .otherwise(latin)
    )


def _count_of(c: Column, chars: str) -> Column:
    return F.length(c) - F.length(F.regexp_replace(c, chars, ""))


def language_bucket(c: Column, supplied: Column | None = None) -> Column:
    """Call-level bucket hi / en / ur / other.

    ``supplied`` is an outside language code (a statistical identifier's answer);
    without one, Latin text counts as English unless it holds Hindi function words.
    The decision looks at the whole text; its thresholds grow with the length.
    """
    code = F.coalesce(F.lower(supplied), F.lit("en")) if supplied is not None else F.lit("en")

    def decide(sample):
        need = F.greatest(F.lit(20), F.floor(F.length(sample) / 50))
        tokens = F.filter(F.split(sample, r"[\s\p{Z}]+"), lambda t: t != "")
        mixed = let(tokens, lambda ts: F.size(F.filter(
            ts, lambda t: F.btrim(F.lower(t), F.lit(".,?!\"'")).isin(C.HINGLISH_MARKERS))) >= F.greatest(F.lit(3), F.floor(F.size(ts) / 25)))
        return (
            F.when(_count_of(sample, DEVANAGARI) >= need, F.lit("hi"))
            .when(_count_of(sample, ARABIC) >= need, F.lit("ur"))
            .when(code == "hi", F.lit("hi"))
            .when(code.isin("ur", "ar", "fa"), F.lit("ur"))
            .when(mixed, F.lit("hi"))
            .when(code == "en", F.lit("en"))
            .otherwise(F.lit("other")))

    return F.when(c.isNull() | (trim_blank(c) == ""), F.lit("en")).otherwise(
        let(c, decide))


def stt_language(code: Column, text: Column, redetect_other: bool) -> Column:
    """Language of a recogniser segment from its language code, else from the text."""
    head = F.lower(F.element_at(F.split(code, "-"), 1))
    mapped = F.coalesce(
        F.when(head.isin(list(C.STT_LANGUAGE_HEADS)), head), F.lit("other"))
    known = F.nullif(code, F.lit("")).isNotNull()
    if redetect_other:
        return F.when(known & (mapped != "other"), mapped).otherwise(detect_language(text))
    return F.when(known, mapped).otherwise(detect_language(text))


def first_text(*columns: Column) -> Column:
    """First column that is neither null nor the empty text, else ''."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def slug(c: Column) -> Column:
    text = F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("untitled"))


def like_escape(needle: str) -> str:
    return needle.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
