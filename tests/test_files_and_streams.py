"""Written files that feed the jobs, streams that go on where they stopped, and JSON that is none."""

import glob
import json
import os
import shutil
import subprocess
import sys
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from callweave import session
from callweave.functions.clean import parse_started_at
from callweave.operators import calls as K
from callweave.operators import density as D
from callweave.operators import merges as M
from callweave.operators import relational as R
from callweave.plans import sources as SO
from callweave.plans.workspace import Workspace
from callweave.sources import readers as RD
from callweave.streaming import jobs as ST

LEAD = {"full_name": "Ann", "phone": "9000000001", "email": None, "grounded_fields": ["phone"]}


@pytest.mark.parametrize("text,want", [
    ("2024-01-31T10:15:00+05:30", datetime(2024, 1, 31, 10, 15)), ("2024-01-31 10:15:00Z", datetime(2024, 1, 31, 10, 15)), ("20240131", datetime(2024, 1, 31)),
    ("20240131T101500", datetime(2024, 1, 31, 10, 15)), ("20240131T1015-0800", datetime(2024, 1, 31, 10, 15)), ("31/01/2024 10:15:01", datetime(2024, 1, 31, 10, 15, 1)),
    ("2024-01-31", datetime(2024, 1, 31)), ("2024-01-31T10:15:00.250", datetime(2024, 1, 31, 10, 15, 0, 250000)), ("garbage", None), ("2024-13-01", None), ("+05:30", None)])
def test_times(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(parse_started_at(F.col("t"))).first()[0] == want


def test_files_feed_the_summary(spark, tmp_path):
    (tmp_path / "cdr.csv").write_text('crux_call_id,caller_number,agent_id,campaign,start_time,direction\n'
                                      'a,9000000001,AG1,"two\nlines",2024-01-02T10:00:00+05:30,in\nb,NA,NA,x,garbage,out\na,9000000002,AG2,last,20240103,in\n')
    (tmp_path / "leads.csv").write_text("MOBILE_NO,LEAD_NO,PRODUCT_TYPE\n9000000002,L2,Loan\n09000000002,L1,Card\n")
    folder = tmp_path / "analyses"
    folder.mkdir()
    for name, indent in (("a", 2), ("b", None)):
        (folder / f"{name}.json").write_text(json.dumps({"call_date": "2024-01-02", "lead": LEAD, "disposition": "resolved", "disposition_confidence": 0.5,
                                                         "escalation": False}, indent=indent))
    (folder / "c.json").write_text("{broken")
    cdr = RD.read_cdr(spark, str(tmp_path / "cdr.csv"))
    assert cdr.count() == 3
    calls = K.with_join_phone(K.calls_with_cdr(RD.read_analyses(spark, str(folder)), cdr))
    rows = {r.call_id: r for r in K.match_leads(calls, RD.read_leads(spark, str(tmp_path / "leads.csv"))).collect()}
    assert set(rows) == {"a", "b"} and rows["a"].join_phone == "9000000002" and rows["a"].agent_id == "AG2"
    assert rows["a"].lead_nos == ["L2", "L1"] and rows["b"].lead_nos == [] and rows["b"].join_phone == "9000000001"
    assert {r.PHONE_NUMBER for r in K.call_summary(calls).collect()} == {"9000000001", "9000000002"}


def test_transcripts_are_read_once(spark, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    os.makedirs(source)
    turn = [{"speaker": "AGENT", "start_ts": 0, "end_ts": 1, "text": "hello", "language": "en"}]
    Path(source, "1.json").write_text(json.dumps(turn))
    assert ST.stream_transcripts(spark, source, out, check).count() == 1
    Path(source, "2.json").write_text(json.dumps(turn * 2))
    assert ST.stream_transcripts(spark, source, out, check).count() == 3
    files = len(list(Path(out).glob("*.parquet")))
    assert ST.stream_transcripts(spark, source, out, check).count() == 3 and len(list(Path(out).glob("*.parquet"))) == files


def test_requests_are_remembered_between_runs(spark, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    kind = "request_id string, route string, ts timestamp_ntz, key string"

    def run(rows):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(source)
        frame = spark.createDataFrame([], kind)
        return sorted(r.request_id for r in ST.dedupe_requests(ST.file_stream(spark, source, frame.schema), out, check).collect())

    assert run([("a", "in", datetime(2024, 1, 1, 0), "k"), ("b", "in", datetime(2024, 1, 1, 1), "k")]) == ["a"]
    assert run([("c", "in", datetime(2024, 1, 1, 23), "k"), ("d", "in", datetime(2024, 1, 2, 1), "k")]) == ["a", "d"]


def feed(spark, source, rows, kind):
    spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(source)
    return ST.file_stream(spark, source, spark.createDataFrame([], kind).schema)


def test_windows_leave_the_store(spark, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    kind = "request_id string, route string, ts timestamp_ntz, key string"

    def run(*rows):
        return sorted(r.request_id for r in ST.dedupe_requests(feed(spark, source, rows, kind), out, check, late_hours=2).collect())

    assert run(("b", "in", datetime(2024, 1, 1, 2), "k"), ("a", "in", datetime(2024, 1, 1, 2), " k "), ("c", "in", datetime(2024, 1, 1, 3), " "),
               ("d", "in", datetime(2024, 1, 3, 1, 59), "k"), ("e", "in", datetime(2024, 1, 3, 1), "k"), ("f", "out", datetime(2024, 1, 1, 2), "k")) == ["a", "c", "e", "f"]
    held = spark.read.format("statestore").option("stateVarName", "start").load(check)
    assert {r.key.route for r in held.collect()} == {"in"}  # the window of "out" is over and gone
    # Late within the bound: covered.  Later than the bound: not taken.  No key: always passes.
    assert run(("g", "in", datetime(2024, 1, 3, 0, 30), "k"), ("h", "in", datetime(2024, 1, 2), "z"), ("i", "in", datetime(2024, 1, 1), None)) == ["a", "c", "e", "f", "i"]
    assert run(("j", "in", datetime(2024, 1, 4, 1), "k")) == ["a", "c", "e", "f", "i", "j"]


def test_late_rows_of_closed_days_no_longer_count(spark, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    kind = "ts timestamp, is_stable boolean"

    def run(*days):
        rows = [(datetime(2024, 1, day, 12), day % 2 == 0) for day in days]
        return sorted((r.day.day, r.touched, r.churned) for r in ST.daily_counts(feed(spark, source, rows, kind), out, check).collect())

    assert run(1, 1, 2, 4) == [(1, 2, 2), (2, 1, 0)]  # the 3rd at noon is the mark
    assert run(3, 2, 4, 4) == [(1, 2, 2), (2, 1, 0)]  # the 2nd is closed
    files = len(list(Path(out).glob("*.parquet")))
    assert run(7) == [(1, 2, 2), (2, 1, 0), (3, 1, 1), (4, 3, 0)]
    assert len(list(Path(out).glob("*.parquet"))) > files


def test_cache_entries_expire(spark, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    kind = "key string, ts timestamp, id string, is_put boolean"
    day = lambda n, hour=0: datetime(2024, 1, n, hour)

    def run(*rows):
        return {r.id: r.hit for r in ST.cache_stream(feed(spark, source, rows, kind), out, check, days=7).collect()}

    def held(name):
        return {r.key.key for r in spark.read.format("statestore").option("stateVarName", name).load(check).collect()}

    # Arrival order is not event order; an equal time is no hit.
    assert run(("a", day(3), "a3", False), ("a", day(1), "pa", True), ("a", day(1), "a1", False), ("b", day(2), "pb", True), ("b", day(3, 6), "b3", False),
               ("c", day(4, 1), "tick", True)) == {"a1": False, "a3": True}
    assert held("entry") == {"a", "b"}
    assert run(("b", day(3, 2), "b2", False), ("a", day(8), "a8", False), ("a", day(7, 23), "a7", False)) == {"a1": False, "a3": True, "b2": True, "b3": True}
    assert run(("c", day(30), "tock", True)) == {"a1": False, "a3": True, "b2": True, "b3": True, "a7": True, "a8": False}
    assert held("entry") == set()  # the last entry itself still waits for the mark


def test_status_is_the_store(spark, tmp_path):
    source, check = str(tmp_path / "in"), str(tmp_path / "check")
    kind = "call_id string, ts timestamp, event_id string, status string, error string"

    def run(*rows):
        return {r.call_id: r.status for r in ST.call_status(feed(spark, source, rows, kind), "", check).collect()}

    assert run(("1", datetime(2024, 1, 2), "e2", "done", None), ("1", datetime(2024, 1, 1), "e1", "queued", None), ("2", None, "e0", "new", "x")) == {"1": "done", "2": "new"}
    assert run(("1", datetime(2024, 1, 1, 5), "e3", "running", None), ("3", datetime(2024, 1, 1), "e4", "new", None)) == {"1": "done", "2": "new", "3": "new"}


def test_bad_json_neither_stops_nor_erases(spark):
    table = spark.createDataFrame([("a", '{"x": 1}'), ("b", "{broken"), ("c", None), ("d", "[1]")], "id string, metadata string")
    got = {r.id: r.v for r in table.select("id", R.json_field("metadata", "x").alias("v")).collect()}
    assert got == {"a": "1", "b": None, "c": None, "d": None}
    values = spark.createDataFrame([(k, '{"y": 2}') for k in "abcd"], "id string, document string")
    merged = {r.id: r.metadata for r in M.set_json_member(table, values, "id", "metadata", "m").collect()}
    assert json.loads(merged["a"]) == {"x": 1, "m": {"y": 2}} and merged["b"] == "{broken" and merged["d"] == "[1]" and json.loads(merged["c"]) == {"m": {"y": 2}}
    assert sorted(r.id for r in M.rejected_json(table, "id", "metadata").collect()) == ["b", "d"]


def test_components_of_a_long_chain(spark):
    edges = spark.range(400).selectExpr("lpad(id, 4, '0') as a", "lpad(id + 1, 4, '0') as b")
    assert {r.root for r in D.components(edges).collect()} == {"0000"}


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Session:
        class sparkContext:
            master = "spark://host:7077"

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(ValueError):
        session.shared_dir(Session)


def test_arrow_query_runs_from_another_folder(tmp_path, folder):
    code = (f"import sys; sys.path.insert(0, {str(Path(session.__file__).parents[1])!r})\n"
            "from callweave.session import local_session\nfrom callweave.plans.catalog import load, runner\n"
            f"print('rows', runner(load()['vec_assign'])(local_session('2'), {folder!r}).count())")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "rows " in done.stdout, done.stderr[-800:]
    shutil.rmtree(tmp_path, ignore_errors=True)


def test_files_to_facts_writes_tables_in_ranges(spark, folder, monkeypatch):
    """Call records and leads go to several files, in the order of their rows."""
    monkeypatch.setattr(SO.RD, "read_leads", lambda s, path, plain=SO.RD.read_leads: paths.append(path) or plain(s, path))
    monkeypatch.setattr(SO.RD, "read_cdr", lambda s, path, plain=SO.RD.read_cdr: paths.append(path) or plain(s, path))
    paths = []
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled",)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = SO.src_files_to_facts(Workspace(spark, folder))
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    ws = Workspace(spark, folder)
    for path, view in zip(paths, ("v_cdr", "v_leads")):
        files = sorted(glob.glob(f"{path.removeprefix('file://')}/part-*.csv"))
        assert len(files) > 1
        rows = [r for f in files for r in spark.read.csv(f, header=True, escape='"', multiLine=True).collect()]
        want = ws[view].orderBy("ordinal").drop("ordinal").collect()
        assert [r[0] for r in rows] == [r[0] for r in want]
    assert len(got.collect()) == ws["v_analyses"].count()


def test_open_windows_ask_the_store_once_a_bucket():
    import pandas as pd

    from callweave.streaming.state import HOUR, OpenWindows

    class Store:
        def __init__(self):
            self.value, self.calls, self.timers = None, 0, []

        def getValueState(self, *_):
            return self

        def exists(self):
            self.calls += 1
            return self.value is not None

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls, self.value = self.calls + 1, value

        def clear(self):
            self.value = None

        def registerTimer(self, at):
            self.timers.append(at)

        def getCurrentWatermarkInMs(self):
            return 25 * HOUR // 1000

    store, windows = Store(), OpenWindows(24)
    windows.init(store)

    def feed(hour, keys):
        frame = pd.DataFrame({"request_id": [f"{hour}-{route}-{k}" for route, k in keys], "route": [route for route, _ in keys],
                              "ts": pd.to_datetime(hour * HOUR, unit="us"), "key": [k for _, k in keys]})
        return sorted(x for part in windows.handleInputRows((0,), iter([frame]), store) for x in part["request_id"])

    many = [(route, f"k{k}") for k in range(200) for route in ("in", None)]
    assert len(feed(0, many)) == 400 and store.calls <= 3 and store.timers == [24 * HOUR // 1000]
    assert feed(3, many[:10] + [("out", "k0")]) == ["3-out-k0"]
    list(windows.handleExpiredTimer((0,), store, None))
    assert [len(x) for x in store.value] == [1, 1, 1] and store.timers[-1] == 27 * HOUR // 1000
    assert len(feed(26, [("out", "k0"), ("in", "k0")])) == 1
