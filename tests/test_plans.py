"""Plan assertions: the physical plans are the ones the design relies on."""

import pytest
from pyspark.sql import functions as F

from mailroom.operators import dashboard as A
from mailroom.operators import knowledge as KB
from mailroom.operators import listing as L
from mailroom.operators import similarity as S
from mailroom.session import scratch_path


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, fx):
    """The message and chunk tables as Parquet, as they are stored in production."""
    e = scratch_path(spark, "plan-emails")
    c = scratch_path(spark, "plan-chunks")
    fx.emails.write.parquet(e)
    KB.chunk(fx.kb_sources).write.parquet(c)
    return spark.read.parquet(e), spark.read.parquet(c)


def test_list_filters_reach_the_scan(stored):
    emails, _ = stored
    p = _plan(L.list_page(emails, page=2, status="sent", urgency="high"))
    assert "PushedFilters: [IsNotNull(status), IsNotNull(urgency), EqualTo(status,sent), EqualTo(urgency,high)]" in p
    assert "TakeOrderedAndProject" in p


def test_kb_listing_prunes_content(stored):
    _, chunks = stored
    p = _plan(KB.kb_metadata(chunks))
    assert "content" not in p.split("ReadSchema:")[1].split("\n")[0]


def test_recent_activity_does_not_move_messages(spark, stored, fx):
    emails, _ = stored
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = _plan(A.recent_activity(fx.activity_log, emails))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "TakeOrderedAndProject" in p and "SortMergeJoin" not in p
    # from the message scan up to the semi join with the broadcast ids, no exchange
    semi = next(line for line in p.splitlines() if "BroadcastHashJoin" in line and "LeftSemi" in line)
    below = p[p.index(semi) + len(semi):]
    scan = below.index("FileScan parquet")
    assert "Exchange" not in below[:scan]


def test_dashboard_is_one_pass_and_jvm_only(stored, fx):
    emails, chunks = stored
    p = _plan(A.dashboard_stats(emails, chunks, "2024-01-31 00:00:00"))
    assert p.count("Expand") == 1              # grouping sets: one scan for every grouped count
    assert "Python" not in p and "MapInPandas" not in p


def test_search_collects_and_broadcasts_nothing(spark, fx, monkeypatch):
    """Planning a search starts no job, and its plan has no broadcast."""
    from pyspark.sql import DataFrame
    for name in ("collect", "toArrow", "toPandas", "count", "first", "take"):
        monkeypatch.setattr(DataFrame, name, lambda self, *a, **k: pytest.fail("a search ran a job while it was planned"))
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, v: pytest.fail("a search broadcast a Python value"))
    df = S.search(fx.kb_queries, KB.kb_index(KB.chunk(fx.kb_sources)), ["q_id"])
    p = _plan(df)
    assert "FlatMapCoGroupsInArrow" in p and "Broadcast" not in p and "BatchEvalPython" not in p


@pytest.mark.parametrize("parts", [1, 64])
def test_results_do_not_depend_on_shuffle_partitions(spark, fx, parts):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    cols = ["q_id", "rank", "upload_id", "chunk_index", "score"]
    base = sorted(tuple(r) for r in S.search(fx.kb_queries, KB.kb_index(KB.chunk(fx.kb_sources)), ["q_id"])
                  .select(*cols).collect())
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        spark.catalog.clearCache()
        got = sorted(tuple(r) for r in S.search(fx.kb_queries, KB.kb_index(KB.chunk(fx.kb_sources)), ["q_id"])
                     .select(*cols).collect())
        kl = sorted(tuple(r) for r in KB.kb_list(KB.chunk(fx.kb_sources)).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.catalog.clearCache()
    assert got == base
    assert kl == sorted(tuple(r) for r in KB.kb_list(KB.chunk(fx.kb_sources)).collect())
    assert F is not None


def test_search_texts_read_the_persisted_parse(spark):
    """The parsed responses stay persisted, so no JSON parse is inlined below the texts."""
    from mailroom.plans import catalog

    p = _plan(catalog.QUERIES["search_query"](spark, "/root/testdata/sf0.001"))
    above = p.split("InMemoryRelation")[0]
    assert "InMemoryTableScan" in p and "try_parse_json" not in above and "try_variant_get" not in above
    spark.catalog.clearCache()


def test_bodies_do_not_pass_through_the_triage_joins(spark, stored):
    """A body's length and its first characters are taken below the first exchange."""
    from mailroom.plans import triage as TR

    emails, chunks = stored
    words = emails.select(F.col("id").alias("email_id"), F.lit("{").alias("response_text"))
    depts = spark.sql("SELECT 1 ord, 'x' id, 'General' name, 'd' description, 't' tone, 's' signature, 0.5D auto_send_threshold")
    made = TR.triage(emails, words, chunks, depts)
    for df in (made.state, made.reply_requests):
        above = [line for line in _plan(df).splitlines() if "Exchange" in line or "Sort " in line or "Join" in line]
        assert above and not any("text_body" in line or "html_body" in line for line in above)
        joined = df._jdf.queryExecution().optimizedPlan()
        assert not any(c in str(n.output()) for n in _nodes(joined) if "Join" in n.nodeName() for c in ("text_body", "html_body"))
    made.release()
    asked = emails.select(F.col("id").alias("email_id"), F.lit(1).alias("seq"), F.lit("regenerate").alias("action"), F.lit("x").alias("custom_instructions")).limit(3)
    regen = TR.regenerate_requests(emails, asked, chunks)
    p = regen._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in p and regen.count() == 3


def _nodes(plan):
    kids = plan.children()
    return [plan, *[n for i in range(kids.size()) for n in _nodes(kids.apply(i))]]


def test_terms_of_large_tables_are_cut_finer(spark, monkeypatch):
    """A task of the index gets 8 MB of scanned text at most, as the table grows."""
    from mailroom.plans import sizing

    monkeypatch.setattr(sizing, "input_bytes", lambda df: 6 << 30)
    chunks = spark.createDataFrame([(1, 0, "a b a")], "upload_id long, chunk_index int, content string")
    assert "hashpartitioning(upload_id#" in (p := _plan(KB.kb_index(chunks))) and ", 768)" in p


def test_triage_outputs_share_one_join_and_one_search(spark, stored, monkeypatch):
    """Messages meet responses once and texts are searched once, however many outputs are
    read; a subject is in no join of the state, and other tables make no more lots of queries."""
    from mailroom.operators import topk_kernel as K
    from mailroom.plans import sizing
    from mailroom.plans import triage as TR

    emails, chunks = stored
    sizes = []
    monkeypatch.setattr(K, "input_bytes", lambda df: (n := sizing.input_bytes(df), sizes.append(n))[0])
    answers = emails.select(F.col("id").alias("email_id"), F.concat(F.lit('{"intent":"a","department":"b","sentiment":"c","urgency":"'), "urgency", F.lit('"}')).alias("response_text"))
    depts = spark.sql("SELECT 1 ord, 'x' id, 'General' name, 'd' description, 't' tone, 's' signature, 0.5D auto_send_threshold")
    made = TR.triage(emails, answers, chunks, depts)
    assert sizes and max(sizes) < 200_000  # the texts alone, not the messages that they come from
    for df in (made.state, made.activity, made.context):
        p = _plan(df)
        assert "FlatMapCoGroupsInArrow" not in p and "InMemoryTableScan" not in p and "subject#" not in p
    assert made.state.count() == emails.count() and made.activity.count() == emails.count()
    made.release()


def test_triage_keys_stand_for_search_texts(spark, stored):
    """Equal texts from unequal parts, texts without a subject, and failed responses."""
    from mailroom.plans import triage as TR

    _, chunks = stored
    schema = "id string, message_id string, sender_name string, sender_email string, subject string, text_body string, html_body string, received_at timestamp_ntz"
    emails = spark.createDataFrame([(f"m{i}", f"<{i}>", "n", "e", s, "body", "", None) for i, s in enumerate(["the", "the of", None, "", "the"])], schema)
    said = '{"intent":"%s","department":"b","sentiment":"c","urgency":"d","key_topics":["the"]}'
    answers = spark.createDataFrame([("m0", said % "of x"), ("m1", said % "x"), ("m2", said % "the"), ("m3", said % "the"), ("m4", "[1]"), ("zz", "[2]"), (None, "[3]")],
                                    "email_id string, response_text string")
    depts = spark.sql("SELECT 1 ord, 'x' id, 'General' name, 'd' description, 't' tone, 's' signature, 0.5D auto_send_threshold")
    made = TR.triage(emails, answers, chunks, depts)
    got = {r.email_id: r for r in made.context.collect()}
    assert [got[f"m{i}"].search_text for i in range(4)] == ["the of x the", "the of x the", " the the", " the the"]
    assert got["m0"].rag_context == got["m1"].rag_context and got["m2"].n_hits == got["m3"].n_hits == 3 and len(got) == 4
    assert {r.id: r.status for r in made.state.collect()}["m4"] == "failed" and made.reply_requests.count() == 4
    assert sorted(str(r.email_id) for r in made.failed.collect()) == ["None", "m4", "zz"]
    assert sorted(str(r.email_id) for r in made.unmatched.collect()) == ["None", "zz"]
    made.release()
