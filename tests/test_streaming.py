from __future__ import annotations

import json
import os
import time

from conftest import rows

from zonetide.plans import id_index, ledger
from zonetide.sources.batches import parse_uploads
from zonetide.streaming import runs, totals, uploads


def document(run, batch, n, date="2026-01-01"):
    return json.dumps(
        {
            "date": date,
            "global": {"domains_tracked_lifetime": n, "domains_tracked_24h": n},
            "length_stats": [{"length": 2, "total_possible": 1296, "tracked_count": n}],
            "length_stats_by_tld": [{"tld": "com", "length": 2, "total_possible": 1296, "tracked_count": n}],
            "word_pos_stats": [],
            "run_id": run,
            "batch_id": batch,
        }
    )


def put(inbox, name, *docs):
    inbox.mkdir(exist_ok=True)
    (inbox / name).write_text("\n".join(docs) + "\n")


def take_in(spark, tmp_path):
    stream = uploads.read_uploads(spark, str(tmp_path / "in"))
    uploads.apply_uploads(stream, str(tmp_path / "stats/v1"), str(tmp_path / "ck")).awaitTermination()
    return uploads.stored_tables(ledger.read(spark, str(tmp_path / "stats/v1")))


def test_replays_count_once(spark, tmp_path):
    inbox = tmp_path / "in"
    put(inbox, "a.json", document("r", "1", 3), document("r", "1", 3), document("r", "2", 4), '{"date":"x"}', "not json")
    tables = take_in(spark, tmp_path)
    assert rows(tables["global_stats"].drop("updated_at")) == [("2026-01-01", 7, 7)]
    put(inbox, "b.json", document("r", "2", 4), document("s", "2", 5))
    tables = take_in(spark, tmp_path)
    assert rows(tables["global_stats"].drop("updated_at")) == [("2026-01-01", 12, 12)]
    assert rows(tables["length_stats"].drop("updated_at")) == [("overall", "ALL", 2, 1296, 12, 0, 0), ("overall", "com", 2, 1296, 12, 0, 0)]
    assert tables["word_pos_stats"].count() == 0
    tables = take_in(spark, tmp_path)  # nothing new
    assert rows(tables["global_stats"].drop("updated_at")) == [("2026-01-01", 12, 12)]


def test_documents_without_ids_count_every_time(spark, tmp_path):
    put(tmp_path / "in", "a.json", document("r", None, 3), document("r", None, 3), document("", "1", 1))
    tables = take_in(spark, tmp_path)
    put(tmp_path / "in", "b.json", document("r", None, 3), document("", "1", 1))
    tables = take_in(spark, tmp_path)
    assert rows(tables["global_stats"].drop("updated_at")) == [("2026-01-01", 11, 11)]


def test_same_files_twice_give_the_same_table(spark, tmp_path):
    results = []
    for home in ("one", "two"):
        base = tmp_path / home
        base.mkdir()
        put(base / "in", "a.json", document("r", "1", 3), document("r", "2", 4))
        put(base / "in", "b.json", document("r", "2", 4), document("r", "3", 1, "2026-01-02"))
        results.append(rows(take_in(spark, base)["global_stats"].drop("updated_at")))
    assert results[0] == results[1] == [("2026-01-01", 7, 7), ("2026-01-02", 1, 1)]


def test_reset(spark, tmp_path):
    put(tmp_path / "in", "a.json", document("r", "1", 3))
    take_in(spark, tmp_path)
    fresh = uploads.reset_statistics(spark, str(tmp_path / "stats/v1"))
    assert fresh.endswith("stats/v2")
    tables = uploads.stored_tables(ledger.read(spark, fresh))
    assert all(t.count() == 0 for t in tables.values())
    # The applied ids are gone too: a replay after the reset counts again.
    stream = uploads.read_uploads(spark, str(tmp_path / "in"))
    uploads.apply_uploads(stream, fresh, str(tmp_path / "ck2")).awaitTermination()
    assert rows(uploads.stored_tables(ledger.read(spark, fresh))["global_stats"].drop("updated_at")) == [("2026-01-01", 3, 3)]


def test_running_totals(spark, tmp_path):
    put(tmp_path / "in", "a.json", document("r", "1", 3), document("r", "2", 4), document("r", "3", 9, "2026-01-02"))
    documents = parse_uploads(spark.readStream.text(str(tmp_path / "in"))).filter("valid")
    query = uploads.running_totals(documents).writeStream.outputMode("complete").format("memory").queryName("totals").trigger(availableNow=True).start()
    query.awaitTermination()
    assert rows(spark.table("totals")) == [("2026-01-01", 7, 7), ("2026-01-02", 9, 9)]


def test_snapshot_and_later_documents(spark, tmp_path):
    ledger_path, snapshot = str(tmp_path / "stats/v1"), str(tmp_path / "snapshot")
    put(tmp_path / "in", "a.json", document("r", "1", 3), document("r", "2", 4))
    take_in(spark, tmp_path)
    uploads.write_snapshot(spark, ledger_path, snapshot, 0)
    put(tmp_path / "in", "b.json", document("r", "2", 4), document("r", "3", 5), document("r", "4", 1, "2026-01-02"))
    whole = take_in(spark, tmp_path)
    since = uploads.tables_since(spark, ledger_path, snapshot, 0)
    for name in whole:
        assert rows(since[name]) == rows(whole[name]), name
    assert rows(since["global_stats"].drop("updated_at")) == [("2026-01-01", 12, 12), ("2026-01-02", 1, 1)]


def test_backlog_in_small_batches(spark, tmp_path):
    for n in range(4):
        put(tmp_path / "in", f"{n}.json", document("r", str(n // 2), 3), document("s", str(n), 1))
    store = str(tmp_path / "stats/v1")
    stream = uploads.read_uploads(spark, str(tmp_path / "in"), files_per_batch=1)
    uploads.apply_uploads(stream, store, str(tmp_path / "ck")).awaitTermination()
    stored = ledger.read(spark, store)
    assert stored.select("epoch").distinct().count() == 4  # every file was its own batch
    assert rows(uploads.stored_tables(stored)["global_stats"].drop("updated_at")) == [("2026-01-01", 10, 10)]


def test_run_log_over_micro_batches(spark, tmp_path):
    schema = "seq bigint, ts string, run_id string, event string, status string, domains_processed string, errors_count string, source string, notes string"
    steps = [
        [(1, "t1", "a", "start", None, None, None, "s", None), (2, "t2", "b", "heartbeat", None, "7", None, None, None)],
        [(3, "t3", "a", "heartbeat", None, "5", None, None, None), (4, "t4", "b", "start", None, None, None, None, None)],
        [(5, "t5", "a", "finish", "failed", "9", "1", None, "why")],
    ]
    inbox, log = str(tmp_path / "in"), str(tmp_path / "log")
    for step in steps:
        spark.createDataFrame(step, schema).coalesce(1).write.mode("append").parquet(inbox)
        stream = runs.state_session(spark.newSession()).readStream.schema(schema).parquet(inbox)
        runs.keep_runs(stream, log, str(tmp_path / "ck")).awaitTermination()
    assert rows(runs.run_log(spark, log).select("run_id", "finished_at", "status", "domains_processed", "notes")) == [
        ("a", "t5", "failed", 9, "why"), ("b", None, "running", 0, None),
    ]


def length_document(batch, total, *more, run="r"):
    rows = [{"tld": "com", "length": 3, "total_possible": t, "tracked_count": 1} for t in (total, *more)]
    return json.dumps({"date": "d", "global": {}, "length_stats": [], "length_stats_by_tld": rows, "run_id": run, "batch_id": batch})


def test_last_document_to_arrive_gives_the_total(spark, tmp_path):
    # one micro-batch of many documents: rows of a document in their order, documents in theirs
    put(tmp_path / "in", "a.json", *[length_document(str(n), n, 1000 + n) for n in range(50)], length_document("last", 5, 7))
    tables = take_in(spark, tmp_path)
    assert rows(tables["length_stats"].drop("updated_at")) == [("overall", "com", 3, 7, 102, 0, 0)]


def test_rejected_lines_are_kept(spark, tmp_path):
    put(tmp_path / "in", "a.json", document("r", "1", 3), "not json", "[1]", '{"date": ""}', '{"date": "d"}', '{"date": "d", "global": {}, "length_stats": 3}', "", "  ")
    take_in(spark, tmp_path)
    kept = ledger.read(spark, uploads.rejects_path(str(tmp_path / "stats/v1")))
    assert dict(map(tuple, kept.select("value", "reason").collect())) == {
        "[1]": "not an object",
        "not json": "not JSON",
        '{"date": "d", "global": {}, "length_stats": 3}': "no list of length_stats",
        '{"date": "d"}': "no global totals",
        '{"date": ""}': "no date",
    }


def test_reset_in_place(spark, tmp_path):
    put(tmp_path / "in", "a.json", document("r", "1", 3), "junk")
    take_in(spark, tmp_path)
    uploads.reset_in_place(spark, str(tmp_path / "stats/v1"))
    put(tmp_path / "in", "b.json", document("r", "1", 4), document("r", "1", 9))
    tables = take_in(spark, tmp_path)
    assert rows(tables["global_stats"].drop("updated_at")) == [("2026-01-01", 4, 4)]


def test_index_reads_few_files_of_its_own_buckets(spark, tmp_path):
    index = str(tmp_path / "ids")
    applied = set()
    most = 0
    for epoch in range(70):
        ids = [(f"run{epoch % 3}", str(epoch * 10 + k)) for k in range(5)]
        id_index.add(spark.createDataFrame(ids, "run_id string, batch_id string").coalesce(1), index, epoch)
        applied |= set(ids)
        found = id_index.segments(spark, index)
        assert [s.first for s in found] == [0, *[s.last + 1 for s in found[:-1]]] and found[-1].last == epoch
        most = max(most, len(found))
    assert most <= (id_index.MERGED - 1) * 3 + 1
    asked = spark.createDataFrame([("run1", "10"), ("run1", "9999"), ("none", "10")], "run_id string, batch_id string")
    rows_read = id_index.lookup(asked, index, 70)
    plan = rows_read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "In(run_id, [none,run1])" in plan or "In(run_id, [run1,none])" in plan
    hits = rows_read.join(asked, ["run_id", "batch_id"], "left_semi").select("run_id", "batch_id", "epoch")
    assert rows(hits) == [("run1", "10", 1)]
    # a batch tried again doesn't meet its own ids; what it wrote before is replaced
    assert id_index.lookup(asked, index, 1).join(asked, ["run_id", "batch_id"], "left_semi").isEmpty()
    everything = id_index._read(spark, index, id_index.segments(spark, index))
    assert {(r.run_id, r.batch_id) for r in everything.collect()} == applied and everything.count() == len(applied)


def test_intake_after_many_epochs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(id_index, "MERGED", 2)
    for n in range(6):
        put(tmp_path / "in", f"{n}.json", document("r", str(n), 1), document("r", str(max(0, n - 3)), 100))
        os.utime(tmp_path / "in" / f"{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))  # files arrive in this order
    store = str(tmp_path / "stats/v1")
    for _ in range(2):
        stream = uploads.read_uploads(spark, str(tmp_path / "in"), files_per_batch=1)
        uploads.apply_uploads(stream, store, str(tmp_path / "ck")).awaitTermination()
        assert rows(uploads.stored_tables(ledger.read(spark, store))["global_stats"].drop("updated_at")) == [("2026-01-01", 6, 6)]
    # a ledger whose index is gone is indexed anew
    id_index.clear(spark, uploads.index_path(store))
    put(tmp_path / "in", "9.json", document("r", "3", 50), document("r", "9", 1))
    os.utime(tmp_path / "in" / "9.json", (1_700_000_009, 1_700_000_009))
    assert rows(take_in(spark, tmp_path)["global_stats"].drop("updated_at")) == [("2026-01-01", 7, 7)]


RUN_EVENT = "seq bigint, ts string, run_id string, event string, status string, domains_processed string, errors_count string, source string, notes string"


def _run_batch(spark, tmp_path, events, idle="7 days"):
    spark.createDataFrame(events, RUN_EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = runs.state_session(spark.newSession()).readStream.schema(RUN_EVENT).parquet(str(tmp_path / "in"))
    query = runs.keep_runs(stream, str(tmp_path / "log"), str(tmp_path / "ck"), idle=idle)
    query.awaitTermination()


def test_finished_and_idle_runs_leave_the_state(spark, tmp_path):
    def event(seq, run, kind, done=None, status=None, notes=None):
        return (seq, f"t{seq}", run, kind, status, done, None, "s", notes)

    _run_batch(spark, tmp_path, [event(k, f"r{k}", "start") for k in range(300)], idle="2 seconds")
    time.sleep(3)
    # all but a few finish; those few are closed, as nothing came of them
    _run_batch(spark, tmp_path, [event(1000 + k, f"r{k}", "finish", str(k), "failed" if k % 2 else None) for k in range(5, 300)] + [event(2000, "new", "start")], idle="2 seconds")
    log = str(tmp_path / "log")
    assert {r.run_id for r in runs.closed_runs(spark, log).collect()} == {f"r{k}" for k in range(5)}
    held = spark.read.format("statestore").option("stateVarName", "facts").load(str(tmp_path / "ck"))
    assert {r.key.run_id for r in held.collect()} == {"new"}
    # what comes late is merged from the log: nothing is lost with the state
    _run_batch(spark, tmp_path, [event(3000, "r1", "finish", "7", "partial", "late"), event(3001, "r2", "heartbeat", "9"), event(3002, "r9", "heartbeat", "8"), event(1, "new", "start")], idle="2 seconds")
    found = {r.run_id: (r.started_at, r.finished_at, r.status, r.domains_processed, r.notes) for r in runs.run_log(spark, log).collect()}
    assert len(found) == 301
    assert found["r1"] == ("t1", "t3000", "partial", 7, "late") and found["r2"] == ("t2", None, "running", 9, None)
    assert found["r9"] == ("t9", "t1009", "failed", 8, None) and found["r8"] == ("t8", "t1008", "success", 8, None)
    assert found["new"][0] == "t1" and {r.run_id for r in runs.closed_runs(spark, log).collect()} == {"r0", "r3", "r4"}


def _late_stream(spark, home, steps):
    """Documents of each step as one file, in order of arrival."""
    for n, step in enumerate(steps):
        docs = [document(f"r{n}", str(i), value, date) for i, (date, value) in enumerate(step)]
        put(home / "in", f"{n}.json", *docs)
        os.utime(home / "in" / f"{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))
    lines = spark.readStream.option("maxFilesPerTrigger", 1).text(str(home / "in"))
    return parse_uploads(lines).filter("valid")


def test_late_rows_add_to_sealed_dates(spark, tmp_path):
    days = [f"2026-01-{d:02d}" for d in range(1, 15)]
    steps = [[(day, n + 1), (days[max(n - 10, 0)], 100), (day, 1)] for n, day in enumerate(days)]
    steps[7].append(("no date", 5))
    steps[9].append(("no date", 6))
    store = str(tmp_path / "totals")
    totals.create(spark, store)
    assert rows(totals.totals(spark, store)) == []
    totals.keep_totals(_late_stream(spark, tmp_path, steps), store, str(tmp_path / "ck"), open_days=2).awaitTermination()
    want = {}
    for step in steps:
        for day, n in step:
            want[day] = want.get(day, 0) + n
    assert rows(totals.totals(spark, store)) == sorted((d, n, n) for d, n in want.items())
    assert [r[0] for r in rows(totals.open_dates(spark, store))] == days[-3:]  # state has the open dates only
    assert sorted(os.listdir(f"{store}/open")) == ["epoch=12", "epoch=13"]


def test_sealed_totals_survive_retries_and_folds(spark, tmp_path):
    schema = "date string, global struct<domains_tracked_lifetime string, domains_tracked_24h string>"
    steps = [[("2026-01-01", ("3", "1"))], [("2026-01-09", ("4", "1")), ("2026-01-01", ("5", "1"))], [(None, ("1", "1")), ("2026-01-02", ("7", "1"))], [("2026-01-08", ("2", "1"))]]
    store = str(tmp_path / "totals")
    totals.create(spark, store)
    for epoch, step in enumerate(steps):
        for _ in range(2):  # every micro-batch is tried twice
            totals.apply_batch(spark.createDataFrame(step, schema), store, epoch, open_days=3, fold_every=2)
    want = sorted([("2026-01-01", 8, 2), ("2026-01-09", 4, 1), (None, 1, 1), ("2026-01-02", 7, 1), ("2026-01-08", 2, 1)], key=repr)
    assert rows(totals.totals(spark, store)) == want
    assert rows(totals.open_dates(spark, store)) == [("2026-01-08", 2, 1), ("2026-01-09", 4, 1)]
    totals.fold(spark, store, 2)
    assert rows(totals.totals(spark, store)) == want
