"""Text jobs: personal data, languages, speakers, chunks and transcript blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave import constants as C
from callweave.functions import pii
from callweave.functions import text as T
from callweave.functions.numbers import one_decimal
from callweave.functions.vec import let
from callweave.session import cut


# --- personal data -----------------------------------------------------------------
def _hit_rows(df: DataFrame, key: str, hits: Column) -> DataFrame:
    return df.select(F.col(key).alias("doc_id"), F.explode(hits).alias("h")).select(
        "doc_id", F.col("h.type").alias("type"), F.col("h.value").alias("value"),
        F.col("h.start").cast("bigint").alias("start_idx"), F.col("h.stop").cast("bigint").alias("end_idx"))


def pii_hits(df: DataFrame, key: str, text: str) -> DataFrame:
    """Every hit before overlap removal."""
    return _hit_rows(df, key, pii.all_hits(F.col(text)))


def pii_segments(df: DataFrame, key: str, text: str, method: str = "mask") -> DataFrame:
    """Hits after overlap removal, with their replacement."""
    rows = _hit_rows(df, key, pii.keep_disjoint(pii.all_hits(F.col(text))))
    return rows.withColumn("replacement", pii.replacement(F.col("type"), F.col("value"), method))


def pii_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """Hits per document and type, counted within the row; documents without a hit are left out."""
    found = df.select(F.col(key).alias("doc_id"), pii.all_hits(F.col(text)).alias("hits")).where(F.size("hits") > 0)

    def count(kind: str) -> Column:
        return F.size(F.filter("hits", lambda h: h["type"] == kind)).cast("bigint").alias(kind.lower())

    return found.select("doc_id", *[count(kind) for kind in C.PII_PATTERNS], F.size("hits").cast("bigint").alias("total"))


def pii_redact(df: DataFrame, key: str, text: str, method: str = "mask") -> DataFrame:
    scanned = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"),
                        pii.keep_disjoint(pii.all_hits(F.col(text))).alias("kept"))
    return scanned.select("doc_id", pii.redact(F.col("text"), F.col("kept"), method).alias("redacted"),
                          F.size("kept").cast("bigint").alias("n_segments"))


# --- languages ---------------------------------------------------------------------
def language_labels(df: DataFrame, key: str, text: str, supplied: str) -> DataFrame:
    return df.select(F.col(key).alias("doc_id"), F.col(supplied).alias("supplied"),
                     T.detect_language(F.col(text)).alias("detected"))


def language_profile(labels: DataFrame) -> DataFrame:
    return labels.groupBy("supplied", "detected").agg(F.count("*").alias("n"))


# --- speakers ------------------------------------------------------------------------
def scored(utterances: DataFrame, brands=()) -> DataFrame:
    text = F.col("text")
    return utterances.withColumn("greeting", T.greets(text, brands)).withColumn(
        "words", T.word_count(text)).withColumn("interrog", T.interrogatives(text))


def token_profile(utterances: DataFrame) -> DataFrame:
    """Average words, question words and greeting share per call and speaker."""
    return scored(utterances).groupBy("call_id", "speaker").agg(
        F.count("*").alias("n"), F.avg("words").alias("avg_words"), F.avg("interrog").alias("avg_interrog"),
        F.avg(F.col("greeting").cast("int")).alias("greeting_share"))


def label_by_parity(scores: DataFrame) -> DataFrame:
    """AGENT / CUSTOMER for calls without diarization.

    One anchor turn per call (first greeting, else the wordiest) is AGENT and
    labels alternate with distance from it, so each label is a closed form of the
    turn number; only the anchor needs an aggregate, which combines map-side.
    """
    anchors = scores.groupBy("call_id").agg(
        F.coalesce(F.min(F.when(F.col("greeting"), F.col("idx"))),
                   F.min_by("idx", F.struct(-F.col("words"), F.col("idx")))).alias("anchor"))
    parity = F.when(F.abs(F.col("idx") - F.col("anchor")) % 2 == 0, F.lit("AGENT")).otherwise(F.lit("CUSTOMER"))
    label = (
        F.when((F.col("words") >= 25) & (parity == "CUSTOMER"), F.lit("AGENT"))
        .when((F.col("interrog") >= 2) & (F.col("words") <= 30) & (parity == "AGENT"), F.lit("CUSTOMER"))
        .otherwise(parity))
    return scores.join(anchors, "call_id").withColumn("speaker", label).drop("anchor")


def speaker_stats(scores: DataFrame) -> DataFrame:
    """Per (call, speaker id): greeting turns, words, question words, opening turn, score."""
    opener = scores.groupBy("call_id").agg(
        F.min_by("speaker_id", F.struct("start_ts", "idx")).alias("first_id"))
    stats = scores.where(F.coalesce("speaker_id", F.lit("")) != "").groupBy("call_id", "speaker_id").agg(
        F.count_if("greeting").alias("greeting_turns"), F.sum("words").alias("words"),
        F.sum("interrog").alias("interrog"))
    opens = F.coalesce(F.col("speaker_id") == F.col("first_id"), F.lit(False))
    score = (F.col("greeting_turns") * 100.0 + F.col("words") * 0.1 - F.col("interrog") * 2.0
             + F.when(opens, 10.0).otherwise(0.0))
    return stats.join(opener, "call_id").withColumn("opens_call", opens).withColumn("score", score).drop("first_id")


def label_speakers(utterances: DataFrame, brands=()) -> DataFrame:
    """Speaker roles: by speaker id where a call has any, else by parity."""
    scores = cut(scored(utterances, brands), "scored")  # three branches read the scores: score each turn once
    best = speaker_stats(scores).groupBy("call_id").agg(
        F.min_by("speaker_id", F.struct(-F.round("score", 9), F.col("speaker_id"))).alias("agent_id"))
    routed = scores.join(best, "call_id", "left")
    by_id = routed.where(F.col("agent_id").isNotNull()).withColumn(
        "speaker",
        F.when(F.coalesce("speaker_id", F.lit("")) == "", F.lit("UNKNOWN"))
        .when(F.col("speaker_id") == F.col("agent_id"), F.lit("AGENT")).otherwise(F.lit("CUSTOMER")))
    by_turn = label_by_parity(routed.where(F.col("agent_id").isNull()))
    return by_id.unionByName(by_turn).drop("agent_id")


# --- transcripts ---------------------------------------------------------------------
def line(speaker: Column, text: Column, start: Column | None = None) -> Column:
    body = F.concat(speaker, F.lit(": "), text)
    if start is None:
        return body
    return F.concat(F.when(start.isNotNull(), F.concat(F.lit("["), one_decimal(start), F.lit("s] "))).otherwise(F.lit("")), body)


def transcript_block(utterances: DataFrame, keys=("call_id",), order="idx") -> DataFrame:
    """One '[12.3s] SPEAKER: text' document per key, lines in turn order."""
    lined = utterances.select(*keys, F.col(order).alias("o"),
                              line(F.col("speaker"), F.col("text"), F.col("start_ts")).alias("l"))
    return lined.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "l"))), lambda x: x["l"]), "\n").alias("block"))


def turn_chunks(utterances: DataFrame, budget: int = C.CHUNK_BUDGET) -> DataFrame:
    """Greedy chunk number of every turn: a chunk closes when the next turn would pass the budget.

    The running size restarts at every chunk, which no running window can say, so
    a fold runs over the turn sizes of a call and keeps only the first turn of each
    chunk (numbers only; the texts stay put and join back on the turn).
    """
    size = F.length("text") + F.length("speaker") + 10
    turns = utterances.select("call_id", "idx", size.cast("bigint").alias("size"))
    start = F.struct(F.lit(0).cast("bigint").alias("filled"), F.expr("cast(array() as array<bigint>)").alias("starts"))

    def step(acc, t):
        opens = (F.size(acc["starts"]) == 0) | (acc["filled"] + t["size"] > budget)
        return F.when(opens, F.struct(t["size"].alias("filled"), F.concat(acc["starts"], F.array(t["idx"])).alias("starts"))).otherwise(
            F.struct((acc["filled"] + t["size"]).alias("filled"), acc["starts"].alias("starts")))

    folded = turns.groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct("idx", "size"))).alias("turns"))
    numbered = let(F.aggregate("turns", start, step)["starts"], lambda starts: F.transform(
        "turns", lambda t: F.struct(t["idx"].alias("idx"), (F.size(F.filter(starts, lambda s: s <= t["idx"])) - 1).cast("bigint").alias("chunk"))))
    return utterances.join(folded.select("call_id", F.inline(numbered)), ["call_id", "idx"])


def embed_keys(questions: DataFrame, role: str = "passage") -> DataFrame:
    """Distinct texts to embed with their key and how many questions share each."""
    body = F.concat_ws(" || ", T.first_text(F.col("normalized_text"), F.col("raw_text")),
                       F.nullif(F.col("english_gloss"), F.lit("")))
    text = F.concat(F.lit(f"{role}: "), F.trim(body))
    return questions.select(text.alias("embed_text")).groupBy("embed_text").agg(
        F.count("*").alias("n_questions")).withColumn("cache_key", F.sha1("embed_text"))
