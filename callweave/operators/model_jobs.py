"""Request tables for models, running a plug-in over them, and normalising what comes back."""

from __future__ import annotations

import time

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave import constants as C
from callweave.functions.clean import clamp_unit, trim_blank
from callweave.functions.numbers import round_exact
from callweave.functions.text import detect_language, language_bucket
from callweave.operators import text as TX
from callweave.operators.relational import cluster_examples
from callweave.operators.windows import central_examples
from callweave.session import cut


# --- requests --------------------------------------------------------------------------
def joined_text(utterances: DataFrame, customer_only: bool = False) -> DataFrame:
    """All turns of a call in order as one text (``text``)."""
    rows = utterances.where("speaker = 'CUSTOMER'") if customer_only else utterances
    return rows.groupBy("call_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), " ").alias("text"))


def extract_requests(utterances: DataFrame, budget: int = C.CHUNK_BUDGET) -> DataFrame:
    """One request per chunk: language bucket of the customer's words, and the transcript block."""
    lines = F.struct("idx", "text")
    spoken = utterances.groupBy("call_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("speaker") == "CUSTOMER", lines))).alias("c"),
        F.array_sort(F.collect_list(lines)).alias("a"))
    words = spoken.select("call_id", language_bucket(F.array_join(F.transform(
        F.when(F.size("c") > 0, F.col("c")).otherwise(F.col("a")), lambda x: x["text"]), " ")).alias("bucket"))
    blocks = TX.transcript_block(TX.turn_chunks(utterances, budget), ("call_id", "chunk"))
    return blocks.join(words, "call_id").select("call_id", "chunk", "bucket", "block")


def analyze_requests(utterances: DataFrame, budget: int = C.ANALYSIS_BUDGET) -> DataFrame:
    """Requests per call and chunk: a call longer than the prompt budget is asked in several parts, each of whole turns."""
    blocks = TX.transcript_block(TX.turn_chunks(utterances, budget), ("call_id", "chunk"))
    return blocks.select("call_id", "chunk", F.concat_ws("#", "call_id", F.col("chunk").cast("string")).alias("request"), "block")


def faq_requests(clusters, members, embeddings, questions) -> DataFrame:
    """Per cluster: language, intents, example count, member count and example lines.

    Clusters without an example come out with status 'no_examples'.
    """
    chosen = central_examples(members, embeddings, clusters, questions)
    listed = chosen.groupBy("cluster_id").agg(F.count("*").alias("n"), F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: F.concat(F.lit("- "), x["text"])), "\n").alias("examples"))
    total = members.groupBy("cluster_id").agg(F.count("*").alias("total"))
    zero = F.lit(0).cast("bigint")
    return (
        clusters.withColumnRenamed("id", "cluster_id").join(listed, "cluster_id", "left").join(total, "cluster_id", "left")
        .select("cluster_id", F.coalesce("dominant_language", F.lit("other")).alias("language"),
                F.coalesce(F.nullif(F.array_join("dominant_intents", ", "), F.lit("")), F.lit("other")).alias("intents"),
                F.coalesce("n", zero).alias("n"), F.coalesce("total", zero).alias("total"), "examples",
                F.when(F.coalesce("n", zero) == 0, F.lit("no_examples")).otherwise(F.lit("ok")).alias("status")))


def relation_requests(candidates, clusters, members, questions, verdicts, as_of: str, n: int = 4, days: int = C.CACHE_TTL_DAYS) -> DataFrame:
    """Per candidate pair both cluster summaries; pairs with an unexpired verdict are skipped."""
    alive = verdicts.where(F.col("cached_at") > F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))).select("source", "target")
    text = F.coalesce(F.nullif("normalized_text", F.lit("")), F.nullif("raw_text", F.lit("")), F.lit(""))
    examples = cluster_examples(members, questions, n).groupBy("cluster_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("position", text.alias("t")))), lambda x: F.concat(F.lit("  - "), x["t"])), "\n").alias("examples"))
    summary = clusters.select(F.col("id").alias("cluster_id"), "canonical_question", "dominant_language",
                              F.coalesce(F.get("dominant_intents", F.lit(0)), F.lit("other")).alias("intent")).join(examples, "cluster_id", "left")

    def side(prefix: str, key: str) -> DataFrame:
        return summary.select(F.col("cluster_id").alias(key), F.coalesce("canonical_question", F.lit("")).alias(f"{prefix}_canonical"),
                              F.col("intent").alias(f"{prefix}_intent"), F.col("dominant_language").alias(f"{prefix}_language"),
                              F.coalesce("examples", F.lit("  (none)")).alias(f"{prefix}_examples"))

    todo = candidates.select("source", "target", "cosine").join(alive, ["source", "target"], "left_anti")
    return todo.join(side("a", "source"), "source").join(side("b", "target"), "target").withColumn(
        "cosine", round_exact(F.col("cosine"), 3))


# --- running a model -------------------------------------------------------------------
def _answered(model, texts: list[str], attempts: int, pause: float, longest: float) -> list[tuple]:
    """(answer, error, attempts) per text.

    A list that fails is halved until the failing text is alone; one bad text among n costs about 2 log2 n calls and spoils no
    other.  A text alone is asked ``attempts`` times.  The wait after a failure doubles up to ``longest`` and falls back after a success.
    """
    done: list[tuple] = [(None, None, 0)] * len(texts)
    waiting, failed = [(0, len(texts), 1)] if texts else [], 0
    while waiting:
        start, stop, tried = waiting.pop()
        if failed and pause:
            time.sleep(min(longest, pause * 2 ** min(failed - 1, 30)))
        try:
            answers = list(model(texts[start:stop]))
            if len(answers) != stop - start:
                raise ValueError(f"{len(answers)} answers to {stop - start} requests")
            done[start:stop] = [(answer, None, tried) for answer in answers]
            failed = 0
        except Exception as exc:  # noqa: BLE001 - a failure stays with its texts
            failed += 1
            if stop - start > 1:
                middle = (start + stop) // 2
                waiting += [(middle, stop, 1), (start, middle, 1)]
            elif tried < attempts:
                waiting.append((start, stop, tried + 1))
            else:
                done[start] = (None, f"{type(exc).__name__}: {exc}", tried)
    return done


def infer_batches(requests: DataFrame, key: str, prompt: str, model, attempts: int = 3, size: int = 32,
                  pause: float = 0.0, longest: float = 30.0) -> DataFrame:
    """Run ``model(list of str) -> list of str`` over every request, up to ``size`` of them a call.

    Result: the key as string, response, error, attempts.  ``attempts`` counts the calls made for a row by itself (1 where its list
    succeeded), so it does not depend on how rows were dealt out.  A null request goes to the model as it is.  The model runs inside the
    tasks; parallelism is the number of partitions.
    """

    def run(batches):
        for batch in batches:
            texts = batch.column(prompt).to_pylist()
            done = [row for at in range(0, len(texts), size) for row in _answered(model, texts[at:at + size], attempts, pause, longest)]
            answers, errors, tries = zip(*done) if done else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(answers, pa.string()), pa.array(errors, pa.string()), pa.array(tries, pa.int64())],
                names=[key, "response", "error", "attempts"])

    return requests.select(F.col(key).cast("string"), prompt).mapInArrow(
        run, f"{key} string, response string, error string, attempts bigint")


def infer(requests: DataFrame, key: str, prompt: str, model, attempts: int = 3) -> DataFrame:
    """Run ``model(str) -> str`` over every request, one call each; a failing row keeps its error and harms no other."""
    return infer_batches(requests, key, prompt, lambda texts: [model(texts[0])], attempts, size=1)


# --- responses -------------------------------------------------------------------------
def _json_of(c: Column) -> Column:
    """Parsed variant of a text that is one complete JSON value, else null.

    The parser stops after the first value, so the text is also checked inside an
    array and inside an object, where anything left over is an error.
    """
    listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))), "$", "array<variant>")
    boxed = F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit("}")))
    return F.when((F.size(listed) == 1) & boxed.isNotNull(), listed[0])


def _outer(text: Column, left: str, right: str) -> Column:
    start = F.instr(text, left)
    stop = F.length(text) - F.instr(F.reverse(text), right) + 1
    return F.when((start > 0) & (F.instr(text, right) > 0) & (start < stop), F.substr(text, start, stop - start + 1))


def recover_json(responses: DataFrame, column: str = "response", list_key: str = "questions") -> DataFrame:
    """Adds ``document`` (JSON object text) and ``is_valid``.

    Tried in turn: fenced blocks, outermost braces, outermost brackets, the raw
    text.  A bare list is wrapped under ``list_key``; any other value is a failure.
    """
    text = F.col(column)
    fences = F.regexp_extract_all(text, F.lit(r"(?is)```(?:json)?[\s\p{Z}]*(.*?)```"), F.lit(1))
    candidates = F.array_compact(F.concat(
        F.transform(fences, trim_blank), F.array(_outer(text, "{", "}"), _outer(text, "[", "]"), trim_blank(text))))
    parsed = F.get(F.filter(F.transform(candidates, _json_of), lambda v: v.isNotNull()), F.lit(0))
    staged = responses.withColumn("_parsed", parsed)
    kind = F.schema_of_variant("_parsed")
    document = (
        F.when(kind.startswith("OBJECT"), F.to_json("_parsed"))
        .when(kind.startswith("ARRAY"), F.concat(F.lit(f'{{"{list_key}":'), F.to_json("_parsed"), F.lit("}"))))
    return staged.withColumn("document", document).withColumn("is_valid", F.col("document").isNotNull()).drop("_parsed")


def _member(name: str) -> Column:
    return F.try_variant_get(F.col("item"), f"$.{name}", "variant")


def _kind(name: str) -> Column:
    """'absent', 'VOID', 'STRING', 'BIGINT', ... of one member."""
    return F.coalesce(F.schema_of_variant(_member(name)), F.lit("absent"))


def _string(name: str) -> Column:
    return F.when(_kind(name) == "STRING", F.try_variant_get(F.col("item"), f"$.{name}", "string"))


def _filled(name: str) -> Column:
    return F.nullif(_string(name), F.lit(""))


def coerce_questions(documents: DataFrame) -> DataFrame:
    """Items of recovered documents as questions with a status.

    ``invalid``: not usable; ``degraded``: intent, confidence or gloss was missing
    and got its default; ``ok`` otherwise.  ``position`` numbers the items of a
    call; a document without a question list gives one invalid row.
    """
    listed = F.try_variant_get(F.try_parse_json("document"), "$.questions", "array<variant>")
    items = documents.where("is_valid").select("call_id", F.posexplode_outer(
        F.coalesce(listed, F.array(F.lit(None).cast("variant")))).alias("position", "item"), listed.isNull().alias("no_list"))
    items = items.where(F.col("no_list") | F.col("position").isNotNull())
    is_object = F.coalesce(F.schema_of_variant("item").startswith("OBJECT"), F.lit(False))
    raw_kind, norm_kind = _kind("raw_text"), _kind("normalized_text")
    aliases = [_filled(n) for n in ("raw_text", "query", "question", "text", "utterance", "normalized_text")]
    staged = items.select(
        "call_id", F.col("position").cast("bigint").alias("position"), is_object.alias("is_object"),
        F.coalesce(*aliases, _string("raw_text")).alias("raw_text"),
        _string("normalized_text").alias("norm"), _filled("language").alias("language"),
        raw_kind.alias("raw_kind"), norm_kind.alias("norm_kind"),
        _kind("question_type").alias("type_kind"), _string("question_type").alias("question_type"),
        _kind("intent").alias("intent_kind"), _string("intent").alias("intent"),
        _kind("english_gloss").alias("gloss_kind"), _string("english_gloss").alias("english_gloss"),
        _kind("secondary_intents").alias("sec_kind"),
        F.try_variant_get("item", "$.secondary_intents", "array<string>").alias("secondary_intents"),
        _kind("confidence").alias("conf_kind"), _filled("confidence").alias("conf_text"),
        F.try_variant_get("item", "$.confidence", "double").alias("confidence"))
    normalized = F.coalesce(F.nullif("norm", F.lit("")), F.nullif("raw_text", F.lit("")), F.col("norm"))
    text_kind = lambda k: F.col(k).isin("STRING", "VOID", "absent")
    staged = staged.withColumn("normalized_text", normalized).withColumn(
        "language", F.when(F.col("language").isin(C.LANGUAGES), F.col("language")).otherwise(
            detect_language(F.coalesce(F.nullif(normalized, F.lit("")), F.nullif("raw_text", F.lit("")), F.lit("")))))
    absent = lambda k: F.col(k) == "absent"
    good = (
        F.col("is_object") & F.col("raw_text").isNotNull() & F.col("normalized_text").isNotNull()
        & text_kind("raw_kind") & text_kind("norm_kind")
        & (absent("type_kind") | F.coalesce(F.col("question_type").isin(C.QUESTION_TYPES), F.lit(False)))
        & (absent("intent_kind") | F.coalesce(F.col("intent").isin(C.INTENTS), F.lit(False)))
        & text_kind("gloss_kind")
        & (absent("sec_kind") | F.coalesce(F.forall("secondary_intents", lambda s: F.coalesce(s.isin(C.INTENTS), F.lit(False))), F.lit(False)))
        & (absent("conf_kind") | F.coalesce(F.col("confidence").between(0.0, 1.0), F.lit(False))))
    missing = (
        F.col("intent_kind").isin("absent", "VOID") | (F.col("intent") == "")
        | F.col("conf_kind").isin("absent", "VOID") | F.col("gloss_kind").isin("absent", "VOID") | (F.col("english_gloss") == ""))
    status = F.when(~good, F.lit("invalid")).when(F.coalesce(missing, F.lit(False)), F.lit("degraded")).otherwise(F.lit("ok"))
    return staged.select(
        "call_id", "position", F.concat("call_id", F.lit("#"), F.coalesce(F.col("position").cast("string"), F.lit("0"))).alias("item_id"),
        "raw_text", "normalized_text", "english_gloss", F.coalesce("question_type", F.lit("question")).alias("question_type"),
        F.coalesce("intent", F.lit("other")).alias("intent"),
        F.coalesce("secondary_intents", F.expr("cast(array() as array<string>)")).alias("secondary_intents"),
        "language", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), status.alias("status"))


# --- grounding -------------------------------------------------------------------------
def _tokens(c: Column) -> Column:
    return F.split(c, r"[\s\p{Z}]+")


GRAM = 3


def _anchor(c: Column) -> Column:
    """Longest word of a text that has a blank on both sides inside it; null when there is none."""
    words = _tokens(c)
    inner = F.when(F.size(words) > 2, F.slice(words, F.lit(2), F.size(words) - 2))
    return F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]


def _grams(word: Column, n: int) -> Column:
    return F.when(F.length(word) >= n, F.transform(F.sequence(F.lit(1), F.length(word) - (n - 1)), lambda i: F.substr(word, i, F.lit(n)))).otherwise(
        F.expr("cast(array() as array<string>)"))


def contained_pairs(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(call_id, inner_id, outer_id) where the inner text lies inside an outer text of the same call.

    Inputs hold call_id, id, t, one row per distinct text of a call.  A word with blanks around it inside the inner text must
    occur as a whole word in the outer one, so candidates meet on (call, word).  A text of one or two words has no such word, but its
    longest word lies inside one word of the outer text: it meets the distinct words of its call on (call, first ``GRAM``
    characters), and through their postings the texts.  No join is on the call alone.
    """
    words = outer.select("call_id", F.col("id").alias("outer_id"), F.explode(F.array_distinct(_tokens(F.col("t")))).alias("word"))
    texts = outer.select("call_id", F.col("id").alias("outer_id"), F.col("t").alias("outer_text"))
    inner = inner.withColumn("anchor", _anchor(F.col("t")))
    whole = inner.where("anchor is not null").withColumnRenamed("anchor", "word")
    longest = F.array_max(F.transform(_tokens(F.col("t")), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    part = inner.where("anchor is null").select("call_id", "id", "t", longest.alias("part")).withColumn("gram", F.substring("part", 1, GRAM))
    parts = part.select("call_id", "part", "gram").distinct()
    met = words.select("call_id", "word").distinct().select("call_id", "word", F.explode(F.array_distinct(F.concat(
        *[_grams(F.col("word"), n) for n in range(1, GRAM + 1)]))).alias("gram")).join(parts, ["call_id", "gram"]).where(
        F.contains("word", "part")).select("call_id", "part", "word")
    wanted = whole.select("call_id", "id", "t", "word").unionByName(part.join(met, ["call_id", "part"]).select("call_id", "id", "t", "word"))
    near = wanted.join(words, ["call_id", "word"]).select("call_id", "id", "t", "outer_id").distinct()
    return near.join(texts, ["call_id", "outer_id"]).where(F.contains("outer_text", "t")).select("call_id", F.col("id").alias("inner_id"), "outer_id")


def ground(questions: DataFrame, utterances: DataFrame) -> DataFrame:
    """Adds ``utterance_id``: the first turn holding the question's text, else the first turn held in it.

    Equal texts of a call are folded to one (with its first turn) before any
    matching, so copies of a sentence cost one comparison.
    """
    folded = lambda c: F.lower(trim_blank(F.col(c)))
    asked = cut(questions.withColumn("t", folded("raw_text")).withColumn("text_id", F.md5("t")), "questions")
    needles = asked.where("t <> ''").select("call_id", F.col("text_id").alias("id"), "t").distinct()
    said = utterances.select("call_id", "idx", "utterance_id", folded("text").alias("t")).where("t <> ''").groupBy("call_id", "t").agg(
        F.min(F.struct("idx", "utterance_id")).alias("first")).withColumn("id", F.md5("t"))
    said = cut(said, "turns")
    inside = contained_pairs(needles, said).select("call_id", F.col("inner_id").alias("text_id"), F.col("outer_id").alias("id"), F.lit(1).alias("tier"))
    around = contained_pairs(said, needles).select("call_id", F.col("outer_id").alias("text_id"), F.col("inner_id").alias("id"), F.lit(2).alias("tier"))
    best = inside.unionByName(around).join(said.select("call_id", "id", "first"), ["call_id", "id"]).groupBy("call_id", "text_id").agg(
        F.min(F.struct("tier", "first")).alias("m"))
    return asked.join(best, ["call_id", "text_id"], "left").select(
        *questions.columns, F.col("m.first.utterance_id").alias("utterance_id"), F.col("m.tier").alias("tier"))


def ground_questions(coerced: DataFrame, utterances: DataFrame, drop: bool = True) -> DataFrame:
    """Valid questions with their turn; unmatched ones are dropped, or kept with status 'ungrounded'."""
    grounded = ground(coerced.where("status <> 'invalid'"), utterances)
    if drop:
        return grounded.where("utterance_id is not null")
    return grounded.withColumn("status", F.when(F.col("utterance_id").isNull(), F.lit("ungrounded")).otherwise(F.col("status")))


def extract_status(coerced: DataFrame, utterances: DataFrame) -> DataFrame:
    """How many items ended ok, degraded, ungrounded or invalid."""
    judged = ground_questions(coerced, utterances, drop=False).select("status")
    return judged.unionByName(coerced.where("status = 'invalid'").select("status")).groupBy("status").agg(F.count("*").alias("n"))


def ground_lead(analyses: DataFrame, utterances: DataFrame) -> DataFrame:
    """Keep name, e-mail and policy number only when the call says them, the phone when its digits occur."""
    said = joined_text(utterances).select("call_id", F.lower("text").alias("said"))
    joined = analyses.join(said, "call_id", "left").withColumn("said", F.coalesce("said", F.lit("")))
    digits = F.regexp_replace("said", r"\P{Nd}", "")
    marks = []
    for field in ("full_name", "email", "policy_no"):
        hit = F.coalesce((F.col(field) != "") & F.contains(F.col("said"), F.lower(F.col(field))), F.lit(False))
        joined = joined.withColumn(f"_{field}", hit)
        marks.append(F.when(F.col(f"_{field}"), F.lit(field)))
    phone_digits = F.regexp_replace("phone", r"\P{Nd}", "")
    joined = joined.withColumn("_phone", F.coalesce((phone_digits != "") & F.contains(digits, phone_digits), F.lit(False)))
    marks.append(F.when(F.col("_phone"), F.lit("phone")))
    out = joined.withColumn("grounded_fields", F.array_compact(F.array(*marks)))
    for field in ("full_name", "email", "policy_no"):
        out = out.withColumn(field, F.when(F.col(f"_{field}") | (F.col(field) == ""), F.col(field)))
    return out.withColumn("phone", F.when(F.col("_phone") | (F.col("phone") == ""), F.col("phone"))).select(*analyses.columns)


def faq_rows(responses: DataFrame, requests: DataFrame, faqs: DataFrame, first_examples: DataFrame) -> DataFrame:
    """FAQ responses as versioned rows; a blank question falls back to the most central example."""
    doc = F.try_parse_json("response")
    text = lambda f: F.nullif(trim_blank(F.try_variant_get("doc", f"$.{f}", "string")), F.lit(""))
    last = faqs.groupBy("cluster_id").agg(F.max("version").alias("last"))
    example = first_examples.select("cluster_id", F.col("text").alias("example"))
    joined = (
        responses.withColumn("doc", doc).join(requests.select("cluster_id", "language"), "cluster_id")
        .join(example, "cluster_id", "left").join(last, "cluster_id", "left"))
    return joined.select(
        "cluster_id", F.coalesce(text("canonical_question"), "example").alias("canonical_question"),
        text("canonical_question_en").alias("canonical_question_en"), text("suggested_answer").alias("suggested_answer"),
        "language", clamp_unit(F.try_variant_get("doc", "$.confidence", "string")).alias("confidence"),
        (F.coalesce("last", F.lit(0)) + 1).cast("bigint").alias("version"))


