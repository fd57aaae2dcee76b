"""Dirty call records: cleaning, resolution and the call summary on hand-made rows."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from callweave.functions import clean as K
from callweave.functions import numbers as N
from callweave.operators import calls as CA
from callweave.operators import knowledge as G
from callweave.sources import writers as WR


def values(spark, rows, fn, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.select("i", fn(F.col("x")).alias("v")).orderBy("i").select("v").collect()]


@pytest.mark.parametrize("raw, want", [
    ("9876543210", "9876543210"), ("+91 98765 43210", "9876543210"), ("09876543210", "9876543210"),
    ("9876543210.0", "9876543210"), ("98765-43210", "9876543210"), ("5876543210", None), ("12345", None),
    ("NA", None), ("", None), ("  ", None), (None, None), ("#N/A", None), ("919876543210", "9876543210"), ("nan", None),
])
def test_mobile(spark, raw, want):
    assert values(spark, [raw], K.normalize_mobile) == [want]


def test_null_spellings(spark):
    rows = ["NA", "n/a", "Null", "none", "#N/A", "nan", "-", "--", " ", " x ", "0"]
    assert values(spark, rows, K.clean_na) == [None] * 9 + ["x", "0"]


def test_timestamps(spark):
    rows = ["2024-02-01 10:11:12", "2024-02-01T10:11:12", "2024-02-01", "01-02-2024 10:11:12", "01/02/2024 10:11:12",
            "01-02-2024", "1/2/2024", "garbage", "2024-02-30", "2024", "NA"]
    noon, day = datetime(2024, 2, 1, 10, 11, 12), datetime(2024, 2, 1)
    assert values(spark, rows, K.parse_started_at) == [noon, noon, day, noon, noon, day, day, None, None, None, None]


def test_direction(spark):
    assert values(spark, ["MT", " in ", "Inbound", "mo", "OUT", "", "x", None], K.parse_direction) == [
        "inbound"] * 3 + ["outbound"] * 2 + ["unknown"] * 3


def test_clamp(spark):
    assert values(spark, ["0.5", "1.4", "-2", "x", None], K.clamp_unit) == [0.5, 1.0, 0.0, 0.0, 0.0]


def test_exact_rounding(spark):
    rows = [0.35, 12.35, 2.25, 2.75, 0.1235, 0.0025, 99.95, 7.0]
    assert values(spark, rows, N.one_decimal, "double") == [f"{x:.1f}" for x in rows]
    assert values(spark, rows, lambda c: N.round_exact(c, 3), "double") == [round(x, 3) for x in rows]


def test_compact_weight(spark):
    rows = [1.0, 0.0, 0.5, 0.85, 0.123456789, 0.00012345678, 0.00001, None]
    assert values(spark, rows, N.compact_weight, "double") == ["" if x is None else f"{x:g}" for x in rows]


CALL = ("call_id string, call_date string, disposition string, disposition_confidence double, disposition_rationale string, "
        "sentiment string, sentiment_confidence double, escalation boolean, full_name string, email string, occupation string, "
        "income_band string, product_interest string, pincode string, phone string, grounded_fields array<string>, caller_phone string")


def call(cid, date="2024-01-01", disp="resolved", conf=0.5, esc=False, name=None, phone=None, grounded=(), cdr=None, product=None):
    return (cid, date, disp, conf, None, "neutral", 0.5, esc, name, None, None, None, product, None, phone, list(grounded), cdr)


def summary(spark, rows):
    df = CA.with_join_phone(spark.createDataFrame(rows, CALL))
    return {r["PHONE_NUMBER"]: r.asDict() for r in CA.call_summary(df).collect()}


def test_summary_winner_and_order(spark):
    got = summary(spark, [
        call("a", "2024-01-01", "info_provided", 0.9, name="First", cdr="9876543210"),
        call("b", "2024-01-03", "callback_requested", 0.4, name=" ", cdr="9876543210"),
        call("c", "2024-01-02", "callback_requested", 0.8, esc=True, name="Third", cdr="09876543210")])
    row = got["9876543210"]
    assert row["CALL_DISPOSITION"] == "callback_requested" and row["CALL_CONFIDENCE"] == "0.4"
    assert row["CALL_ESCALATION"] == "true" and row["CALL_N_CALLS"] == "3" and row["CALL_LAST_DATE"] == "2024-01-03"
    assert row["CALL_SOURCE_CALL_IDS"] == "b,c,a" and row["CALL_LEAD_NAME"] == "Third"


def test_summary_undated_counts_as_newest(spark):
    row = summary(spark, [call("a", "2024-01-01", name="Dated", cdr="9876543210"), call("b", "", name="Undated", cdr="9876543210")])["9876543210"]
    assert row["CALL_SOURCE_CALL_IDS"] == "b,a" and row["CALL_LEAD_NAME"] == "Undated" and row["CALL_LAST_DATE"] == "2024-01-01"


def test_summary_ungrounded_phone_is_ignored(spark):
    assert summary(spark, [call("a", phone="9876543210"), call("b", phone="9876543211", grounded=["phone"])]).keys() == {"9876543211"}


def test_summary_unknown_disposition_ranks_last(spark):
    row = summary(spark, [call("a", disp="mystery", cdr="9876543210"), call("b", disp="other", cdr="9876543210")])["9876543210"]
    assert row["CALL_DISPOSITION"] == "other"


def test_phone_mismatch(spark):
    df = CA.with_join_phone(spark.createDataFrame([
        call("a", phone="9876543211", grounded=["phone"], cdr="9876543210"), call("b", phone="9876543210", grounded=["phone"], cdr="9876543210"),
        call("c", phone="9876543211", cdr="9876543210")], CALL))
    assert {r.call_id: r.phone_mismatch for r in df.collect()} == {"a": True, "b": False, "c": False}


def test_last_row_wins_and_missing_headers(spark):
    raw = spark.createDataFrame([("1", "9876543210", 1), ("1", "9876543211", 2), ("", "9876543212", 3), ("NA", "x", 4)],
                                "crux_call_id string, caller_number string, ordinal bigint")
    got = CA.last_wins(CA.conform_cdr(raw), "crux_call_id").collect()
    assert [(r.crux_call_id, r.caller_phone, r.agent_id, r.direction) for r in got] == [("1", "9876543211", None, "unknown")]


def test_graph_merge_is_idempotent(spark):
    calls = CA.with_join_phone(spark.createDataFrame([
        call("a", cdr="9876543210", name="Ann", product="Motor"), call("b", cdr="9876543210", product=" motor ")], CALL)).withColumn(
        "has_cdr", F.lit(True)).withColumn("agent_id", F.lit("AG1")).withColumn("campaign", F.lit("NA")).withColumn(
        "lead_nos", F.array(F.lit("L1"))).withColumn("products", F.array(F.lit("motor"), F.lit("health")))
    nodes, edges = G.call_nodes(calls), G.call_edges(calls)
    once = sorted(map(str, G.merge_nodes(nodes).collect()))
    assert once == sorted(map(str, G.merge_nodes(nodes.unionByName(nodes)).collect()))
    kinds = sorted(r.type for r in G.merge_nodes(nodes).collect())
    assert kinds == ["agent", "call", "call", "disposition", "lead", "product", "product", "sentiment"]
    first = G.merge_edges_by_weight(edges).count()
    assert first == G.merge_edges_by_weight(edges.unionByName(edges)).count()
    lead = [r for r in G.merge_nodes(nodes).collect() if r.type == "lead"][0]
    assert lead.label == "Ann" and lead.attrs["lead_nos"] == "L1" and lead.attrs["matched"] == "true"


def test_edge_keeps_greater_weight_first_on_ties(spark):
    edges = spark.createDataFrame([("x", "y", "r", 0.4, "low", 1), ("x", "y", "r", 0.9, "high", 2), ("x", "y", "r", 0.9, "late", 3)],
                                  "src_id string, dst_id string, relation string, weight double, reason string, seq int")
    assert [(r.weight, r.reason) for r in G.merge_edges_by_weight(edges).collect()] == [(0.9, "high")]


def test_notes_hold_every_row_of_a_hub(spark):
    nodes = spark.createDataFrame([("sentiment:good", "sentiment", "good")], "id string, type string, label string")
    edges = spark.createDataFrame([(f"call:{i}", "call", "sentiment:good", "sentiment", "has_sentiment", 0.5, "a|b") for i in range(50)],
                                  "src_id string, src_type string, dst_id string, dst_type string, relation string, weight double, reason string")
    lines = [r.text for r in G.notes(nodes, edges).orderBy("name", "section", "line").collect()]
    assert lines[:2] == ["# good", ""] and len(lines) == 56 and sum("[[" in x and "a\\|b" in x for x in lines) == 50


def test_self_loop_is_listed_once(spark):
    edges = spark.createDataFrame([("call:1", "call", "call:1", "call", "similar_to", 1.0, None)],
                                  "src_id string, src_type string, dst_id string, dst_type string, relation string, weight double, reason string")
    assert [(r.direction, r.weight) for r in G.related(edges).collect()] == [("out", "1")]


def test_note_joins_never_broadcast_a_table_that_grows(spark):
    calls = spark.range(50).select(F.concat(F.lit("call:"), "id").alias("id"), F.lit("call").alias("type"), F.lit("Call").alias("label"))
    edges = calls.select(F.col("id").alias("src_id"), F.col("type").alias("src_type"), F.lit("agent:a").alias("dst_id"), F.lit("agent").alias("dst_type"),
                         F.lit("handled_by").alias("relation"), F.lit(1.0).alias("weight"), F.lit(None).cast("string").alias("reason"))
    nodes = calls.unionByName(spark.createDataFrame([("agent:a", "agent", "a")], "id string, type string, label string"))
    notes = G.notes(nodes, edges)
    assert "Broadcast" not in notes._jdf.queryExecution().executedPlan().toString()
    assert notes.where("section = 1").count() == 100


def _hub_graph(spark):
    edge = "src_id string, src_type string, dst_id string, dst_type string, relation string, weight double, reason string"
    calls = spark.range(40).select(F.concat(F.lit("call:"), "id", F.when(F.col("id") % 2 == 0, "!").otherwise("")).alias("id"), F.lit("call").alias("type"), F.lit("Call").alias("label"))
    extra = spark.createDataFrame([("call:1?", "call", "Twin"), ("agent:a", "agent", "a")], "id string, type string, label string")
    edges = calls.unionByName(extra.where("type = 'call'")).select(F.col("id").alias("src_id"), F.col("type").alias("src_type"), F.lit("agent:a").alias("dst_id"),
        F.lit("agent").alias("dst_type"), F.lit("handled_by").alias("relation"), F.lit(0.5).alias("weight"), F.col("id").alias("reason"))
    return calls.unionByName(extra), edges.unionByName(spark.createDataFrame([("call:gone", "call", "agent:a", "agent", "handled_by", 1.0, None)], edge))


def test_notes_of_a_hub_in_parts_keep_the_first_of_equal_rows(spark):
    nodes, edges = _hub_graph(spark)
    rows = [r for r in G.notes(nodes, edges).where("section = 1").collect() if r.id == "agent:a"]
    assert len(rows) == 41  # call:1 and call:1? have one name, the first is kept; an end without a node is listed, but has no note
    assert [r.text for r in rows if "[[call-call-1]]" in r.text] == ["| handled_by | [[call-call-1]] | 0.5 | call:1 |"]


def test_lines_of_notes_are_shuffled_once_and_written_compressed(spark, tmp_path):
    nodes, edges = _hub_graph(spark)
    notes = G.notes(nodes, edges)
    plan = notes._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "Exchange" in x]
    assert len(dealt) == 2, plan  # one of the lines, one of the notes' names
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    WR.write_notes(notes, str(tmp_path / "notes"))
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
    files = [p.name for p in (tmp_path / "notes").glob("folder=*/*") if not p.name.startswith(".")]
    assert files and all(f.endswith(".json.gz") for f in files)
    back = spark.read.json(str(tmp_path / "notes"))
    assert sorted(r.text for r in back.collect()) == sorted(r.text for r in notes.collect())
