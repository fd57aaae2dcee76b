"""Text jobs and model responses on hand-made rows, checked against plain Python where possible."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from callweave import constants as C
from callweave.functions import text as T
from callweave.operators import model_jobs as MJ
from callweave.operators import text as TX


def one(spark, text, fn):
    return spark.createDataFrame([(text,)], "x string").select(fn(F.col("x")).alias("v")).first()["v"]


# --- personal data ---------------------------------------------------------------------
SAMPLES = [
    "call 123-45-6789 or (743) 555-1234, mail a.b@c.com", "é9876543210 9876543210 1234-5678-9012 ABCDE1234F",
    "12345-6789 x@y.co|z 555 123 4567", "123456789012 123456789 1234567890", "no data here", "", "नाम 987-654-3210 है",
    "a@b.com,c@d.org;ABCDE1234FABCDE1234F ABCDE9999Z", "555.123.4567x 555.123.4567",
]


def expected_hits(text):
    found = []
    for rank, (kind, pattern) in enumerate(C.PII_PATTERNS.items()):
        found += [(m.start(), m.end(), rank, kind, m.group()) for m in re.finditer(pattern, text)]
    ssn = [(s, e) for s, e, _, k, _ in found if k == "SSN"]
    return sorted(h for h in found if h[3] != "PHONE" or not any(s <= h[0] < e or s < h[1] <= e for s, e in ssn))


def test_hit_positions_match_plain_regex(spark):
    rng = random.Random(5)
    parts = ["123-45-6789", "9876543210", "x.y@mail.com", "1234-5678-9012", "ABCDE1234F", " ", ", ", "word", "é", "न", "\n", "12345-6789"]
    texts = SAMPLES + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(200)]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, t string")
    got = {}
    for r in TX.pii_hits(df, "id", "t").collect():
        got.setdefault(int(r.doc_id), []).append((r.start_idx, r.end_idx, r.type, r.value))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == sorted((s, e, k, v) for s, e, _, k, v in expected_hits(t)), t


def test_redaction_leaves_nothing_behind(spark):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(SAMPLES)], "id string, t string")
    removed = TX.pii_redact(df, "id", "t", "remove").withColumnRenamed("redacted", "t")
    first = {r.doc_id: r.t for r in removed.collect()}
    for i, t in enumerate(SAMPLES):
        last, kept = -1, []
        for s, e, *_ in expected_hits(t):
            if s >= last:
                kept.append((s, e))
                last = e
        for s, e in reversed(kept):
            t = t[:s] + t[e:]
        assert first[str(i)] == t
    masked = {r.doc_id: r.redacted for r in TX.pii_redact(df, "id", "t").collect()}
    assert masked["0"] == "call ***-**-6789 or (***-***-1234, mail a***@c.com"
    assert masked["1"].endswith("****-****-9012 AB***4F")


# --- languages ------------------------------------------------------------------------
@pytest.mark.parametrize("text, want", [
    ("", "other"), ("   ", "other"), ("1234 !!", "other"), ("மேரி hello", "ta"), ("నా policy", "te"), ("मेरी पॉलिसी", "hi"),
    ("मेरी policy", "hi-en"), ("mera claim kyun nahi hua", "hi-en"), ("ji ho", "hi-roman"), ("hello there my friend", "en"),
    ("aa bb cc dd ee ff gg hh hai", "hi-en"), ("Kya HAI", "hi-en"),
])
def test_detect_language(spark, text, want):
    assert one(spark, text, T.detect_language) == want


@pytest.mark.parametrize("text, code, want", [
    ("", None, "en"), ("नमस्ते " * 10, None, "hi"), ("سلام " * 20, None, "ur"), ("hello", "hi", "hi"), ("hello", "fa", "ur"),
    ("hello", "ta", "other"), ("kya, hai? aap!", "ta", "hi"), ("policy premium sir madam policy", None, "en"), ("hello", None, "en"),
])
def test_language_bucket(spark, text, code, want):
    row = spark.createDataFrame([(text, code)], "x string, c string")
    assert row.select(T.language_bucket(F.col("x"), F.col("c")).alias("v")).first()["v"] == want


def test_word_and_question_counts(spark):
    assert one(spark, "It's a b-c मेरी 'x' __", T.word_count) == len(re.findall(r"[^\W](?:[\w']*\w)?", "It's a b-c म र 'x' __"))
    assert one(spark, "kyun? what??", T.interrogatives) == 6  # kyu, kyun, what and three marks
    assert one(spark, "this is fine", T.greets) is True
    assert one(spark, "this is fine", lambda c: T.greets(c, whole_word=True)) is False


# --- speakers and chunks ------------------------------------------------------------------
UTT = "utterance_id string, call_id string, idx bigint, speaker string, speaker_id string, start_ts double, end_ts double, text string"


def utterances(spark, texts, ids=None, speaker="UNKNOWN", call="c"):
    rows = [(f"{call}-{i}", call, i, speaker, ids[i] if ids else None, float(i * 10), float(i * 10 + 5), t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, UTT)


def labels(df):
    return [r.speaker for r in df.orderBy("idx").collect()]


def test_parity_from_first_greeting(spark):
    texts = ["yes", "hello bajaj here", "ok", "fine", "word " * 30, "kya kab batao"]
    assert labels(TX.label_speakers(utterances(spark, texts))) == ["CUSTOMER", "AGENT", "CUSTOMER", "AGENT", "AGENT", "CUSTOMER"]


def test_parity_from_wordiest_turn_without_greeting(spark):
    assert labels(TX.label_speakers(utterances(spark, ["yes", "one two", "ok sure yes", "no"]))) == ["AGENT", "CUSTOMER", "AGENT", "CUSTOMER"]


def test_roles_by_speaker_id(spark):
    texts = ["hello there", "kya kab", "good morning", "yes"]
    assert labels(TX.label_speakers(utterances(spark, texts, ["b", "a", "b", None]))) == ["AGENT", "CUSTOMER", "AGENT", "UNKNOWN"]
    assert labels(TX.label_speakers(utterances(spark, texts, ["z", "z", None, "z"]))) == ["AGENT", "AGENT", "UNKNOWN", "AGENT"]


def test_chunks_follow_the_greedy_fold(spark):
    rng = random.Random(3)
    texts = ["x" * rng.randint(0, 120) for _ in range(80)]
    want, size, chunk = [], 0, 0
    for t in texts:
        n = len(t) + len("UNKNOWN") + 10
        if size and size + n > 300:
            chunk, size = chunk + 1, 0
        size += n
        want.append(chunk)
    got = TX.turn_chunks(utterances(spark, texts), 300).orderBy("idx").collect()
    assert [r.chunk for r in got] == want


# --- responses ---------------------------------------------------------------------------
def recovered(spark, text):
    row = MJ.recover_json(spark.createDataFrame([("c", text)], "call_id string, response string")).first()
    return json.loads(row.document) if row.is_valid else None


@pytest.mark.parametrize("text, want", [
    ('{"questions": []}', {"questions": []}), ('x ```json\n{"a": 1}\n``` y', {"a": 1}), ('Sure {"a": {"b": 2}} bye', {"a": {"b": 2}}),
    ("[1, 2]", {"questions": [1, 2]}), ('{"a":1} and {"b":2}', None), ("nothing", None), ("", None), ('{"a": ', None), ("5", None),
    ('```\n[{"x": 1}]\n```', {"questions": [{"x": 1}]}), ("{'a': 1}", None),
])
def test_recover_json(spark, text, want):
    assert recovered(spark, text) == want


def statuses(spark, items):
    docs = spark.createDataFrame([("c", json.dumps({"questions": items}), True)], "call_id string, document string, is_valid boolean")
    return {r.position: r for r in MJ.coerce_questions(docs).collect()}


def test_coercion(spark):
    full = {"raw_text": "q", "normalized_text": "n", "english_gloss": "g", "question_type": "doubt", "intent": "renewal",
            "secondary_intents": [], "language": "en", "confidence": 0.4}
    got = statuses(spark, [
        full, {**full, "language": "ur"}, {"query": "Mera claim kab"}, {**full, "confidence": 1.2}, {**full, "intent": "party"},
        {**full, "intent": None}, "text", {**full, "secondary_intents": ["party"]}, {**full, "english_gloss": None}, {"intent": "renewal"},
        {**full, "confidence": "0.7"}, {**full, "raw_text": 5}])
    assert [got[i].status for i in range(12)] == [
        "ok", "ok", "degraded", "invalid", "invalid", "invalid", "invalid", "invalid", "degraded", "invalid", "ok", "invalid"]
    assert got[1].language == "en" and got[2].normalized_text == "Mera claim kab" and got[2].intent == "other"
    assert got[2].language == "hi-en" and got[10].confidence == 0.7


def test_document_without_list_gives_one_invalid_row(spark):
    docs = spark.createDataFrame([("c", '{"answer": 1}', True), ("d", '{"questions": []}', True)], "call_id string, document string, is_valid boolean")
    assert [(r.call_id, r.status) for r in MJ.coerce_questions(docs).collect()] == [("c", "invalid")]


def test_grounding_tiers(spark):
    turns = utterances(spark, ["I want to renew my motor policy today please", "hm", "I want to renew my motor policy", "ok then", "ok then"])
    asked = [("1", "renew my motor policy"), ("2", "well hm well"), ("3", "never said this thing"), ("4", "OK THEN"), ("5", "renew"), ("6", "  ")]
    questions = spark.createDataFrame([("c", i, t) for i, t in asked], "call_id string, item_id string, raw_text string")
    got = {r.item_id: (r.utterance_id, r.tier) for r in MJ.ground(questions, turns).collect()}
    assert got == {"1": ("c-0", 1), "2": ("c-1", 2), "3": (None, None), "4": ("c-3", 1), "5": ("c-0", 1), "6": (None, None)}


def test_grounding_equals_brute_force(spark):
    rng = random.Random(11)
    words = ["a", "bb", "policy", "renew", "claim", "my", "the", "x"]
    turns = [" ".join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(60)]
    asked = [" ".join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(60)]
    questions = spark.createDataFrame([("c", str(i), t) for i, t in enumerate(asked)], "call_id string, item_id string, raw_text string")
    got = {int(r.item_id): r.utterance_id for r in MJ.ground(questions, utterances(spark, turns)).collect()}
    for i, t in enumerate(asked):
        inside = [n for n, u in enumerate(turns) if t in u] or [n for n, u in enumerate(turns) if u in t]
        assert got[i] == (f"c-{inside[0]}" if inside else None)


def test_failing_rows_do_not_harm_others(spark):
    def model(text):
        if text == "bad":
            raise ValueError("no")
        return text.upper()

    df = spark.createDataFrame([("1", "a"), ("2", "bad"), ("3", "c")], "id string, prompt string")
    got = {r.id: (r.response, r.error, r.attempts) for r in MJ.infer(df, "id", "prompt", model, attempts=2).collect()}
    assert got == {"1": ("A", None, 1), "2": (None, "ValueError: no", 2), "3": ("C", None, 1)}


def test_one_bad_text_costs_few_calls():
    calls = []

    def model(texts):
        calls.append(len(texts))
        if "bad" in texts:
            raise ValueError("no")
        return [t.upper() for t in texts]

    texts = [f"t{i}" for i in range(64)]
    texts[37] = "bad"
    done = MJ._answered(model, texts, 3, 0.0, 0.0)
    assert done == [(None, "ValueError: no", 3) if t == "bad" else (t.upper(), None, 1) for t in texts]
    assert len(calls) == 1 + 2 * 6 + 2  # the list, two halves on each of six levels, two more tries of the text alone
    assert MJ._answered(model, [], 3, 0.0, 0.0) == []


def test_short_answer_lists_and_growing_waits(monkeypatch):
    waits = []
    monkeypatch.setattr(MJ.time, "sleep", waits.append)
    assert MJ._answered(lambda texts: texts[:1], ["a", "b", "c"], 2, 1.0, 3.0) == [("a", None, 1), ("b", None, 1), ("c", None, 1)]
    waits.clear()
    down = MJ._answered(lambda texts: 1 / 0, ["a", "b"], 3, 1.0, 3.0)
    assert [d[2] for d in down] == [3, 3] and waits == [1.0, 2.0, 3.0, 3.0, 3.0, 3.0]


def test_batches_over_partitions(spark):
    rows = [(i, None if i % 50 == 0 else "bad" if i % 7 == 0 else f"t{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, prompt string").repartition(5)

    def model(texts):
        if "bad" in texts:
            raise TimeoutError("late")
        return [t and t.upper() for t in texts]

    got = {int(r.id): (r.response, r.error, r.attempts) for r in MJ.infer_batches(df, "id", "prompt", model, attempts=2, size=16).collect()}
    assert got == {i: (None, "TimeoutError: late", 2) if t == "bad" else (t and t.upper(), None, 1) for i, t in rows}
    assert MJ.infer_batches(df.where("false"), "id", "prompt", model).collect() == []


def test_contained_pairs_of_short_and_long_texts(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 5)))
    text = lambda n: " ".join(word() for _ in range(n))
    sides = []
    for sizes in ((1, 1, 1, 2, 2, 3, 5), (1, 2, 4, 9, 30)):
        sides.append({(f"c{rng.randint(0, 3)}", text(rng.choice(sizes))) for _ in range(150)} | {("c0", "a"), ("c0", "bé aé")})
    inner, outer = ([(c, f"{k}", t) for k, (c, t) in enumerate(sorted(side))] for side in sides)
    frames = [spark.createDataFrame(rows, "call_id string, id string, t string") for rows in (inner, outer)]
    got = sorted(tuple(r) for r in MJ.contained_pairs(*frames).collect())
    assert got == sorted((c, i, o) for c, i, t in inner for d, o, u in outer if c == d and t in u)
    plan = MJ.contained_pairs(*frames)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert len(joins) >= 4 and all(" AND " in line for line in joins)  # none meets on the call alone
