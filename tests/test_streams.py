"""Streams drained over a few files equal their batch twins, whatever the files' order."""

import pytest
from pyspark.sql import functions as F

from foliate import streaming
from foliate.operators import events


def test_lifecycle_over_several_batches(spark, tmp_path):
    rows = [(d, f"2024-01-01 00:00:{i:02d}", i, i % 4 == 3) for i in range(24) for d in (1, 2)]
    log = spark.createDataFrame(rows, "document_id long, ts string, event_id long, is_valid boolean").withColumn("ts", F.to_timestamp("ts"))
    for k in range(3):
        log.filter((F.col("event_id") >= 8 * k) & (F.col("event_id") < 8 * k + 8)).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    key = ["document_id", "event_id", "status", "retry_count"]
    got = {tuple(r) for r in streaming.fold_lifecycle(stream).select(key).collect()}
    assert got == {tuple(r) for r in events.lifecycle(log).select(key).collect()}


def test_deliveries_over_several_batches(spark, tmp_path):
    rows = [(m, f"2024-01-{i + 1:02d} 00:00:00", i, m == 2 and i == 3) for i in range(6) for m in (1, 2, 3) if m < 3 or i == 5]
    log = spark.createDataFrame(rows, "message_id long, attempt_ts string, event_id long, ok boolean").withColumn("attempt_ts", F.to_timestamp("attempt_ts"))
    for k in range(3):
        log.filter((F.col("event_id") >= 2 * k) & (F.col("event_id") < 2 * k + 2)).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    got = {tuple(r) for r in streaming.fold_deliveries(stream).select("message_id", "status", "retry_count").collect()}
    assert got == {tuple(r) for r in events.delivery_status(log).collect()}


def unordered(spark, rows, schema, time, days, folder):
    """A stream of one file a batch, the files in the given order of days, far apart."""
    frame = spark.createDataFrame(rows, schema).withColumn(time, F.to_timestamp(time))
    for k in days:
        frame.filter(F.to_date(time) == k).coalesce(1).write.mode("append").parquet(folder)
    return frame, spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_windows_count_rows_that_come_late_and_the_last_day(spark, tmp_path):
    days = ["2024-06-01", "2024-01-01", "2024-06-01", "2024-03-01"]
    rows = [(f"{d} 0{i}:00:00", t) for d in sorted(set(days)) for i in range(3) for t in "ab"]
    frame, stream = unordered(spark, rows, "ts string, event_type string", "ts", days, str(tmp_path / "events"))
    got = {(str(r.begin)[:10], r.event_type): r.n for r in streaming.window_counts(stream).collect()}
    assert got == {(d, t): 3 * days.count(d) for d in days for t in "ab"}


def test_deliveries_in_any_order(spark, tmp_path):
    """The success of message 1 comes first but is last; of message 2 the reverse; message 3 is dead by the time it succeeds."""
    days = ["2024-12-01", "2024-01-01", "2024-05-01", "2024-03-01"]
    ok = {1: ["2024-12-01"], 2: ["2024-01-01"], 3: ["2024-12-01"]}
    rows = [(m, d, i, d in ok[m]) for m in ok for i, d in enumerate(sorted(days)) if m != 1 or d != "2024-03-01"]
    frame, stream = unordered(spark, rows, "message_id long, attempt_ts string, event_id long, ok boolean", "attempt_ts", days, str(tmp_path / "log"))
    got = {tuple(r) for r in streaming.fold_deliveries(stream).select("message_id", "status", "retry_count").collect()}
    assert got == {tuple(r) for r in events.delivery_status(frame).collect()} == {(1, "completed", 2), (2, "completed", 0), (3, "dead_letter", 3)}


def test_conflicts_among_facts_that_arrive_together_or_one_after_another(spark, tmp_path):
    schema = "fact_id long, project_id long, subject_id long, predicate string, object_text string, confidence double, status string, created_at timestamp, deleted_at timestamp"
    row = lambda i, subject, value: (i, 1, subject, "dose", value, 0.9, "unverified", None, None)
    for n, rows in enumerate([[row(1, 1, "5 mg"), row(2, 1, "6 mg")], [row(3, 1, "7 mg"), row(4, 2, "1")], [row(5, 2, "2"), row(6, 3, "1")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    known = spark.createDataFrame([row(7, 3, "9"), row(1, 1, "5 mg")], schema)
    reports = spark.createDataFrame([], "first_fact_id long, second_fact_id long, status string")
    new = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = sorted((r.first_fact_id, r.second_fact_id, r.kind) for r in streaming.detect_conflicts(new, known, reports).collect())
    assert got == [(1, 2, "numeric"), (1, 3, "numeric"), (2, 3, "numeric"), (4, 5, "numeric"), (6, 7, "numeric")]


FACT = "fact_id long, project_id long, subject_id long, predicate string, object_text string, confidence double, status string, created_at timestamp, deleted_at timestamp"
NO_REPORTS = "first_fact_id long, second_fact_id long, status string"


def changed(spark, folder, batches, known, reports=()):
    for rows in batches:
        frame = spark.createDataFrame([(i, 1, s, "dose", v, 0.9, "unverified", None, None, c, n) for i, s, v, c, n in rows], FACT + ", change string, version int")
        frame.coalesce(1).write.mode("append").parquet(folder)
    log = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    old = spark.createDataFrame([(i, 1, s, "dose", v, 0.9, "unverified", None, None) for i, s, v in known], FACT)
    out = streaming.watch_conflicts(log, old, spark.createDataFrame(list(reports), NO_REPORTS))
    return sorted((r.first_fact_id, r.second_fact_id, r.kind) for r in out.collect())


CHANGES = [
    [(1, 1, "5 mg", "insert", 1), (2, 1, "6 mg", "insert", 1), (None, 1, "6 mg", "insert", 1), (9, None, "6 mg", "insert", 1)],
    [(2, 1, "6 mg", "update_preimage", 1), (2, 1, "5 mg", "update_postimage", 2)],
    [(3, 1, "7 mg", "insert", 1), (3, 1, "7 mg", "delete", 1)],
    [(7, 1, "5 mg", "update_preimage", 0), (7, 1, "8 mg", "update_postimage", 1)],
    [(8, 1, "9 mg", "delete", 0)],
]
KNOWN = [(6, 1, "5 mg"), (7, 1, "5 mg"), (8, 1, "9 mg")]


def test_changes_take_back_what_they_replace_in_any_order(spark, tmp_path):
    """2 comes to agree with 1; 3 goes; 7, known, changes and so meets 6, known too; 8 goes. Rows without an id or a subject meet none."""
    wanted = [(1, 2, "duplicate"), (1, 6, "duplicate"), (1, 7, "numeric"), (2, 6, "duplicate"), (2, 7, "numeric"), (6, 7, "numeric")]
    for k, order in enumerate([[0, 1, 2, 3, 4], [4, 3, 2, 1, 0], [1, 3, 0, 4, 2]]):
        assert changed(spark, str(tmp_path / f"log{k}"), [CHANGES[i] for i in order], KNOWN) == wanted


def test_changes_leave_out_open_reports_and_end_on_unknown_changes(spark, tmp_path):
    assert changed(spark, str(tmp_path / "a"), CHANGES[:1], [], [(2, 1, "open")]) == []
    assert changed(spark, str(tmp_path / "b"), CHANGES[:1], [], [(1, 2, "resolved")]) == [(1, 2, "numeric")]
    with pytest.raises(Exception, match="no change is called moved"):
        changed(spark, str(tmp_path / "c"), [[(1, 1, "5 mg", "moved", 1)]], [])


def test_a_subject_with_most_facts_is_dealt_over_salts(spark, tmp_path):
    rows = [(i, 1 if i % 3 else i, f"{i} mg", "insert", 1) for i in range(60)]
    got = changed(spark, str(tmp_path / "hot"), [rows[:30], rows[30:]], [])
    hot = [i for i in range(60) if i % 3]
    assert got == [(a, b, "numeric") for a in hot for b in hot if a < b]


def test_deliveries_write_the_attempts_that_count_and_hold_no_state(spark, tmp_path, monkeypatch):
    rows = [(1, None, 1, None), (1, "2024-01-02", 2, True), (1, "2024-01-03", 3, False), (2, "2024-01-01", 4, True), (2, "2024-01-01", 4, False)] + [(3, "2024-01-01", 10 + i, False) for i in range(50)]
    frame = spark.createDataFrame(rows, "message_id long, attempt_ts string, event_id long, ok boolean")
    frame.coalesce(1).write.parquet(str(tmp_path / "log"))
    written, before = [], streaming.drained

    def drained(stream, *rest):
        assert "WithState" not in stream._jdf.queryExecution().logical().toString()
        written.append(before(stream, *rest))
        return written[-1]

    monkeypatch.setattr(streaming, "drained", drained)
    got = streaming.fold_deliveries(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "log")))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in events.delivery_status(frame).collect()} == {(1, "completed", 1), (2, "completed", 0), (3, "dead_letter", 3)}
    assert written[0].count() == 2 + 1 + 3


def test_conflicts_write_signed_rows_and_hold_no_state(spark, tmp_path, monkeypatch):
    """A batch writes a row for each change, the stream joins nothing; a subject of many new facts is dealt over tasks."""
    written, before = [], streaming.drained

    def drained(stream, *rest):
        assert "Join" not in stream._jdf.queryExecution().logical().toString()
        written.append(before(stream, *rest))
        return written[-1]

    monkeypatch.setattr(streaming, "drained", drained)
    rows = [(i, 1 if i % 4 else 2, f"{i} mg", "insert", 1) for i in range(40)] + [(1, 1, "1 mg", "delete", 1), (100, 1, "100 mg", "update_preimage", 0), (100, 1, "3 mg", "update_postimage", 1)]
    known = [(100, 1, "100 mg"), (101, 1, "7 mg"), (102, 1, "7 mg")]
    log = spark.createDataFrame([(i, 1, s, "dose", v, 0.9, "rejected" if i == 5 else "unverified", None, None, c, n) for i, s, v, c, n in rows], FACT + ", change string, version int")
    log.repartition(3).write.parquet(str(tmp_path / "log"))
    old = spark.createDataFrame([(i, 1, s, "dose", v, 0.9, "unverified", None, None) for i, s, v in known], FACT)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    got = streaming.watch_conflicts(stream, old, spark.createDataFrame([], NO_REPORTS), many=3)
    value = {i: i for i in range(40) if i != 1} | {100: 3, 101: 7, 102: 7}
    subject = {i: 2 if i < 40 and i % 4 == 0 else 1 for i in value}
    wanted = {(a, b, "duplicate" if value[a] == value[b] else "numeric") for a in value for b in value if a < b and subject[a] == subject[b] and (a, b) != (101, 102)}
    rejected = {(a, b, k) for a, b, k in wanted if 5 in (a, b) and max(a, b) > 100}
    # 5 counts as new but is no sibling: it meets those that are siblings, known ones too
    assert rejected and sorted(map(tuple, got.collect())) == sorted(wanted)
    assert written[0].count() == len(rows)
