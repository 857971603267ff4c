"""Streams against their batch forms: any order of arrival, repeated batches, state that goes."""

import json
import random

from selvedge.functions.fixed import FIELDS
from selvedge.operators import feedback, rates, service
from selvedge.streaming import ingest, jobs, ordered

SECOND = 1_000_000


def arrivals(spark, tmp_path, rows, schema, name="in", size=40):
    """A stream that reads the rows in files of `size`, one file a batch, in the order given."""
    folder = tmp_path / name
    for k in range(0, len(rows), size):
        spark.createDataFrame(rows[k : k + size], schema).coalesce(1).write.mode("append").parquet(str(folder / f"n={k:06d}"))
    return spark.readStream.schema(schema + ", n int").option("maxFilesPerTrigger", 1).parquet(str(folder)).drop("n")


def run(stream, tmp_path, name="out"):
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def shuffled(rng, rows, at, within):
    """Rows in an order in which none comes more than `within` after a newer one."""
    return [r for _, r in sorted(((r[at] + rng.randrange(within), r) for r in rows), key=lambda x: x[0])]


def test_admission_in_any_order(spark, tmp_path):
    rng = random.Random(3)
    rows = [(key, rng.randrange(400) * SECOND, 1000 * key + i) for key in range(4) for i in range(60)]
    schema = "key long, ts long, event_id long"
    late = (99, 10_000 * SECOND, 1)  # moves the watermark past all others, and waits
    stream = ordered.admission(arrivals(spark, tmp_path, shuffled(rng, rows, 1, 50 * SECOND) + [late], schema), per_minute=3, per_day=12, late="60 seconds")
    run(stream, tmp_path)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    expected = sorted(map(tuple, rates.admission(spark.createDataFrame(rows, schema), per_minute=3, per_day=12).collect()))
    assert [r for r in got if r[0] != 99] == expected and {r[3] for r in expected} == {True, False}


def state_rows(query):
    return sum(s["numRowsTotal"] for s in (query.lastProgress or {"stateOperators": []})["stateOperators"])


def test_state_goes_after_a_day(spark, tmp_path):
    """A day after the last request of all but one key, only that key's request waits."""
    schema = "key long, ts long, event_id long"
    rows = [(key, key * SECOND, key) for key in range(1, 30)]
    held = run(ordered.admission(arrivals(spark, tmp_path, [*rows, (0, 200 * SECOND, 0)], schema, "a", 100), late="1 second"), tmp_path, "out-a")
    assert state_rows(held) >= 29
    far = [(0, 2 * 86_400 * SECOND, 0), (0, 3 * 86_400 * SECOND, 1)]
    gone = run(ordered.admission(arrivals(spark, tmp_path, rows + far, schema, "b", 29), late="1 second"), tmp_path, "out-b")
    assert 0 < state_rows(gone) <= 4


def test_log_sessions(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for job in range(6):
        at = 0
        for i in range(40):
            at += rng.choice([1, 2, 5, 29, 30, 31, 100])
            rows.append((f"job {job}", at * SECOND, i, service.DONE if rng.random() < 0.15 else f"line {i}"))
    schema = "job_id string, at long, ord int, msg string"
    late = ("end", 100_000 * SECOND, 0, "x")
    run(ordered.log_sessions(arrivals(spark, tmp_path, shuffled(rng, rows, 1, 8 * SECOND) + [late], schema), late="20 seconds"), tmp_path)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    expected = sorted(map(tuple, service.log_sessions(spark.createDataFrame(rows, schema)).collect()))
    assert got == expected and {r[4] for r in expected} == {"done", "silent"}


def test_keepalives(spark):
    rows = [("j", 0, 0, "a\nb"), ("j", 95 * SECOND, 1, "c"), ("j", 125 * SECOND, 2, service.DONE), ("j", 500 * SECOND, 3, "after"), ("k", 5, 0, "alone")]
    got = sorted((r.job_id, r.at // SECOND, r.msg or "") for r in service.keepalives(spark.createDataFrame(rows, "job_id string, at long, ord int, msg string")).collect())
    assert got == [("j", 0, "a  b"), ("j", 30, ""), ("j", 60, ""), ("j", 90, ""), ("j", 95, "c"), ("j", 125, "DONE"), ("k", 0, "alone")]


PAPERS = {
    "a.txt": b"PACKING LIST of the shipment\nInvoice No: INV/7,\nLot No   Roll No   Shade   Length (M)   Net Weight\nL1   R1   A   10 m   5.00\n\"   R2   A   12 m   6.00\n",
    "b.txt": b"",
    "c.txt": b"\xff\xfe\x00broken",
    "d.txt": b" \n\f \n",
    "e.txt": b"Delivery note with some more words\nPO: AB-100,\n\fsecond page of it with text",
}


def test_jobs_have_one_outcome_each(spark, tmp_path):
    folder, store = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    for name in ("a.txt", "b.txt", "c.txt"):
        (folder / name).write_bytes(PAPERS[name])
    work = lambda: jobs.process(jobs.arrived(spark, str(folder)), store, str(tmp_path / "cp")).awaitTermination()
    work()
    for name in ("d.txt", "e.txt"):
        (folder / name).write_bytes(PAPERS[name])
    work()
    found = jobs.Store(spark, store)
    rows = {r.file.rsplit("/", 1)[1]: r for r in found.jobs().collect()}
    assert {n: (r.status, r.error) for n, r in rows.items()} == {"a.txt": ("done", None), "c.txt": ("failed", "the file is no text"), "d.txt": ("failed", "no text on any page"), "e.txt": ("done", None)}
    record = json.loads(rows["a.txt"].record)
    assert (record["pieces"], record["meters"], record["invoice_number"], record["mapping_source"]) == (2, 22.0, "INV/7", "regex")
    assert json.loads(rows["d.txt"].record) == {"mapping_source": "error", "flagged_fields": ",".join(sorted(FIELDS))}
    assert sorted((r.jobs, r.failed) for r in found.batches().collect()) == [(2, 1), (2, 1)]


def batch_of(spark, names):
    return spark.createDataFrame([(n, n, None, bytearray(PAPERS[n])) for n in names], "job_id string, file string, came timestamp, content binary")


def test_batches_run_twice_and_unfinished_ones(spark, tmp_path):
    store = str(tmp_path / "store")
    found = jobs.Store(spark, store)
    assert found.jobs().count() == 0 and found.batches().count() == 0
    for _ in range(2):
        jobs.commit(batch_of(spark, ["a.txt", "b.txt", "a.txt"]), 0, store)
    assert sorted(r.job_id for r in found.ids().collect()) == ["a.txt", "b.txt"]
    jobs.outcomes_of(batch_of(spark, ["e.txt"])).write.parquet(f"{store}/outcomes/batch=1")  # lost before its manifest
    assert found.get("e.txt").count() == 0 and found.get("a.txt").first().status == "done"
    found.delete(spark.createDataFrame([("a.txt",), ("nobody",)], "job_id string"))
    assert [r.job_id for r in found.ids().collect()] == ["b.txt"]
    jobs.commit(batch_of(spark, ["a.txt", "e.txt"]), 1, store)
    assert sorted((r.job_id, r.batch) for r in found.jobs().collect()) == [("a.txt", 1), ("b.txt", 0), ("e.txt", 1)]


def test_learning_and_compaction(spark, tmp_path):
    """A batch's work is its own changes; templates are the same before and after a compaction, and after batches on top of it."""
    schema = "supplier_name string, seq long, field string, action string, value string, at long"
    rows = [(f"s{i % 5}" if i % 11 else "unknown", i, ["lot", "color", "nothing"][i % 3], ["confirm", "reassign", "not_present"][i % 7 % 3], f"v{i}", i // 2) for i in range(120)]
    log = str(tmp_path / "log")

    def learn(some, name):
        stream = arrivals(spark, tmp_path, some, schema, name, 20)
        ingest.learn(stream, log, str(tmp_path / "cp")).awaitTermination()

    def templates():
        return {r.supplier_name: (r.fields, r.correction_count) for r in feedback.templates_of(ingest.changes(spark, log)).collect()}

    assert templates() == {}
    learn(rows[:80], "actions")
    before = templates()
    ingest.compact(spark, log)
    assert templates() == before and len(before) == 5
    for k in range(80, 120, 20):
        spark.createDataFrame(rows[k : k + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "actions" / f"n={k:06d}"))
    learn([], "actions")
    whole = feedback.changes(spark.createDataFrame(rows, schema))
    assert templates() == {r.supplier_name: (r.fields, r.correction_count) for r in feedback.templates_of(whole).collect()}
    assert ingest.history(spark, log).count() == whole.count()


def test_templates_over_time(spark):
    week = feedback.SLICE
    log = [("s", "lot", "A", 10, 1), ("s", "lot", "B", 10, 2), ("s", "color", "red", 3 * week, 3), ("s", "lot", "C", 9 * week, 4), ("t", "lot", "T", 5, 5)]
    over_time = feedback.versions(spark.createDataFrame(log, "supplier_name string, field string, value string, at long, seq long"))
    docs = [(1, "s", 9), (2, "s", 10), (3, "s", 2 * week), (4, "s", 3 * week), (5, "s", 9 * week - 1), (6, "s", 9 * week), (7, "s", 50 * week), (8, "unknown", 50 * week), (9, None, 1), (10, "t", 30 * week), (11, "u", 7)]
    got = {r.doc_id: r.fields for r in feedback.lookup_at(spark.createDataFrame(docs, "doc_id long, supplier_name string, at long"), over_time).collect()}
    assert got == {1: None, 2: {"lot": "B"}, 3: {"lot": "B"}, 4: {"lot": "B", "color": "red"}, 5: {"lot": "B", "color": "red"}, 6: {"lot": "C", "color": "red"}, 7: {"lot": "C", "color": "red"}, 8: None, 9: None, 10: {"lot": "T"}, 11: None}
    assert feedback.lookup_at(spark.createDataFrame([], "doc_id long, supplier_name string, at long"), over_time).count() == 0
