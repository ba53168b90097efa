"""Streaming = batch; a rerun from the checkpoint adds nothing; inputs are
split over at least three micro-batches."""

from pyspark.sql import functions as F

from mailroom.operators import decisions as D
from mailroom.operators import ingest as I
from mailroom.session import scratch_path
from mailroom.streaming import jobs as J


def _replay(spark, df, order, name):
    src = scratch_path(spark, name)
    files = J.write_ordered_files(df, src, order)
    return src, files


def test_dedup_stream_batches_and_restart(spark, fx):
    raw = fx.raw_messages.select("id", "message_id", "received_at", "subject")
    src, files = _replay(spark, raw, "received_at", "t-dedup")
    assert files >= 3
    out, ck = scratch_path(spark, "t-dedup-out"), scratch_path(spark, "t-dedup-ck")
    q = J.stream_dedup(J.file_stream(spark, src, raw.schema), out, ck)
    q.awaitTermination()
    assert len([p for p in q.recentProgress if p["numInputRows"] > 0]) >= 3
    first = spark.read.parquet(out).count()
    assert first == I.message_dedup(raw).count()
    q2 = J.stream_dedup(J.file_stream(spark, src, raw.schema), out, ck)   # same checkpoint
    q2.awaitTermination()
    assert spark.read.parquet(out).count() == first


def test_decision_stream_equals_batch_fold(spark, fx):
    src, _ = _replay(spark, fx.decisions, "seq", "t-dec")
    base = scratch_path(spark, "t-dec-out")
    q = J.stream_decisions(J.file_stream(spark, src, fx.decisions.schema), fx.emails, f"{base}/log",
                           f"{base}/act", f"{base}/ck")
    q.awaitTermination()
    log = J.read_or_empty(spark, f"{base}/log", J._log_schema(spark))
    got = sorted(tuple(r) for r in J.decision_state(fx.emails, log).select(*J.STATE_COLS).collect())
    state, acts = D.apply_decisions(fx.emails, fx.decisions)
    want = sorted(tuple(r) for r in state.select(*J.STATE_COLS).collect())
    assert got == want
    assert spark.read.parquet(f"{base}/act").count() == acts.count()


def test_watermark_dedup_variant_runs(spark, fx):
    raw = fx.raw_messages.select("id", "message_id", "received_at", "subject").filter("message_id IS NOT NULL")
    src, _ = _replay(spark, raw, "received_at", "t-wm")
    stream = J.dedup_within_watermark(J.file_stream(spark, src, raw.schema))
    out = scratch_path(spark, "t-wm-out")
    q = (stream.writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", scratch_path(spark, "t-wm-ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == got.select("message_id").distinct().count()
    assert got.count() == raw.select("message_id").distinct().count()


def test_daily_volume_late_data_and_watermark(spark):
    import datetime as dt
    src = scratch_path(spark, "t-late")
    batches = [
        [("a", dt.datetime(2024, 1, 10, 12)), ("b", dt.datetime(2024, 1, 10, 13))],
        [("c", dt.datetime(2024, 1, 15, 0))],                 # watermark moves to 01-14 00:00
        [("d", dt.datetime(2024, 1, 14, 12)),                 # late, within the delay: always counted
         ("e", dt.datetime(2024, 1, 12, 0))],                 # beyond the watermark: may be dropped
    ]
    schema = "id string, received_at timestamp_ntz"
    for rows in batches:
        spark.createDataFrame(rows, schema).repartition(1).write.mode("append").parquet(src)
    out, ck = scratch_path(spark, "t-late-out"), scratch_path(spark, "t-late-ck")
    q = J.stream_daily_volume(J.file_stream(spark, src, schema), out, ck)
    q.awaitTermination()
    got = {str(r.day): r.c for r in J.latest(spark.read.parquet(out), ["day"]).collect()}
    # Spark guarantees only one direction: rows within the delay are counted;
    # rows older than the watermark may or may not be.
    assert got.pop("2024-01-12", 1) == 1
    assert got == {"2024-01-10": 2, "2024-01-15": 1, "2024-01-14": 1}


def test_triage_stream_sees_changed_tables(spark):
    """Messages and passages come and go between batches. Every response ends
    in state, pending or dead letter; a pending one is taken up later."""
    import datetime as dt
    at = dt.datetime(2024, 1, 10)
    message = "id string, message_id string, sender_name string, sender_email string, subject string, text_body string, html_body string, received_at timestamp_ntz"
    chunk = "id string, upload_id long, name string, file_type string, content string, chunk_index int, department string, created_at timestamp_ntz"
    rows = lambda *ids: spark.createDataFrame(
        [(i, f"<{i}>", "", "a@b", f"about zebra {i}", "body " * 20, "", at) for i in ids], message)
    kb = lambda *names: spark.createDataFrame(
        [(n, k, n, "text", "zebra passage", 0, "general", at) for k, n in enumerate(names)], chunk)
    dep = spark.createDataFrame([(1, "d", "Support", "x", "t", "s", 0.95)],
                                "ord int, id string, name string, description string, tone string, signature string, auto_send_threshold double")
    base, src = scratch_path(spark, "t-triage"), scratch_path(spark, "t-triage-src")
    emails, chunks = f"{base}/emails", f"{base}/chunks"
    full = '{"intent":"order_status","department":"Support","sentiment":"neutral","urgency":"low"}'

    def respond(*pairs):
        spark.createDataFrame(list(pairs), J.RESPONSE_DDL).repartition(1).write.mode("append").parquet(src)

    def run():
        tables = lambda: J.TriageTables(spark.read.parquet(emails), spark.read.parquet(chunks), dep)
        q = J.stream_triage(J.file_stream(spark, src, J.RESPONSE_DDL), tables, base, f"{base}/ck")
        q.awaitTermination()
        assert q.exception() is None and not spark.sparkContext._jsc.getPersistentRDDs()

    spark.catalog.clearCache()
    rows("m1", "m2").write.parquet(emails)
    kb("k1").write.parquet(chunks)
    respond(("m1", full), ("m2", "[1]"), ("late", full), ("never", full))
    run()
    rows("late", "m3").write.mode("append").parquet(emails)
    kb().write.mode("overwrite").parquet(chunks)  # the passage is deleted
    respond(("m3", full))
    run()
    state = {r.id: r for r in J.latest(spark.read.parquet(f"{base}/state"), ["id"]).collect()}
    assert {i: (r.status, r.has_kb) for i, r in state.items()} == {
        "m1": ("auto_sent", True), "m2": ("failed", False), "late": ("pending_approval", False), "m3": ("pending_approval", False)}
    assert [r.email_id for r in spark.read.parquet(f"{base}/dead").collect()] == ["m2"]
    assert [r.email_id for r in spark.read.parquet(f"{base}/pending/batch_id=1").collect()] == ["never"]


def test_only_a_missing_table_counts_as_empty(spark):
    import pytest
    from pyspark.errors import AnalysisException
    assert J.read_or_empty(spark, scratch_path(spark, "nothing"), "a long").count() == 0
    path = scratch_path(spark, "t-there")
    spark.range(1).write.parquet(path)
    with pytest.raises(AnalysisException):
        J.read_or_empty(spark, path, "id long, id long").count()


def test_replay_files_are_written_in_one_pass_and_in_order(spark):
    """However many files: two passes over the rows (count and cuts; files), ranges in the order of their times."""
    passes = spark.sparkContext.accumulator(0)

    def counted(batches):
        passes.add(1)
        yield from batches

    rows = spark.range(0, 4000, 1, 1).select(F.when(F.col("id") % 100 != 0, 3999 - F.col("id")).alias("id"), F.col("id").alias("k"))
    path = scratch_path(spark, "ordered")
    assert J.write_ordered_files(rows.mapInArrow(counted, rows.schema), path, "id", parts=8) == 8
    assert passes.value <= 4
    got = spark.read.parquet(path).select("id", F.input_file_name().alias("f"), F.col("_metadata.file_modification_time").alias("t"))
    ranges = got.groupBy("f").agg(F.min("id"), F.max("id"), F.max("t")).collect()
    assert len(ranges) == 8 and got.count() == 3960
    by_time = sorted(ranges, key=lambda r: r[3])
    assert all(a[2] < b[1] and a[3] < b[3] for a, b in zip(by_time, by_time[1:]))


def test_only_the_stored_body_moves_through_the_dedup(spark):
    """The body is chosen below the exchange of the dedup: neither raw body passes it."""
    raw = spark.createDataFrame([("a", "<1>", "x@y", "s", "text", "<p>html</p>", None)],
                                "id string, message_id string, sender_raw string, subject string, text_body string, html_body string, received_at timestamp")
    from mailroom.operators import ingest as I
    df = J._first_arrivals(I.with_sender(raw))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    merged = next(line for line in plan.splitlines() if "Aggregate" in line)
    assert "body_text" in merged and "text_body" not in merged and "html_body" not in merged and "sender_raw" not in merged
    assert df.columns == J.INGEST_COLS and [r.body_text for r in df.collect()] == ["text"]


def test_responses_of_a_batch_are_parsed_by_all_cores(spark, fx, monkeypatch):
    """One file of responses: the parse has as many tasks as twice the cores, not one."""
    from mailroom.plans import triage as TR
    from mailroom.session import scratch_path
    from mailroom.streaming import jobs

    src, base, parts = scratch_path(spark, "t-one"), scratch_path(spark, "t-one-out"), []
    fx.responses.limit(40).coalesce(1).write.parquet(src)
    monkeypatch.setattr(jobs, "triage", lambda e, r, *a, **k: (parts.append(r.rdd.getNumPartitions()), TR.triage(e, r, *a, **k))[1])
    from mailroom.operators import knowledge as KB
    q = J.stream_triage(J.file_stream(spark, src, fx.responses.schema), lambda: J.TriageTables(fx.emails, KB.chunk(fx.kb_sources), fx.departments), base, f"{base}/ck")
    q.awaitTermination()
    assert q.exception() is None and parts == [2 * spark.sparkContext.defaultParallelism]
    assert spark.read.parquet(f"{base}/state").count() == 40


def test_ids_of_a_batch_take_one_file_for_each_bucket(spark):
    """Ids from many tasks: a bucket's ids lie in one file, not in one for each task."""
    from mailroom.operators.seen import SeenIds
    path = scratch_path(spark, "t-seen-files")
    SeenIds(spark, path, 4).remember(spark.range(4000).repartition(8).select(F.concat(F.lit("<"), "id", F.lit(">")).alias("message_id")), 0)
    ids = spark.read.parquet(f"{path}/ids")
    assert ids.count() == 4000 and len(ids.inputFiles()) == 4
