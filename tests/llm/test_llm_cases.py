"""Inputs that once crashed an operator or lost rows."""

import gzip
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailroom.llm import html_extract, jaccard_join, line_dedup, mixing, toxicity, util, warc
from mailroom.session import scratch_path


def test_one_of_each_with_repeated_and_null_ids(spark):
    text = {c: " ".join(f"{c}{i}" for i in range(40)) for c in "abc"}
    rows = [(1, text["a"]), (1, text["b"]), (2, text["a"]), (None, text["c"]), (None, text["c"]), (3, text["c"] + " end"), (None, None), (4, "")]
    got = jaccard_join.one_of_each(spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, rep int, class_id string"))
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted(
        [(1, text["a"]), (1, text["b"]), (3, text["c"] + " end"), (None, None), (4, "")], key=str)


def test_mix_with_columns_named_like_its_own(spark):
    rows = [(i, f"s{i % 3}", "word " * (i % 50), 1, 2, 3, "m") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, shard int, copy int, place int, rank string")
    got = mixing.mix(docs, block_words=200, shard_words=3000)
    assert got.columns == [*docs.columns, "_mx_copy", "_mx_shard", "_mx_place"]
    assert {(r["shard"], r["copy"], r["place"], r["rank"]) for r in got.collect()} == {(1, 2, 3, "m")}


def test_line_dedup_of_a_table_with_n_removed(spark):
    got = line_dedup.line_dedup(spark.createDataFrame([(1, "a text", "own")], "doc_id long, text string, n_removed string"))
    assert got.columns == ["doc_id", "text", "n_removed", "_ld_n_removed"] and tuple(got.first()) == (1, "a text", "own", 0)


@pytest.mark.parametrize("mark", ["1.5", "auto", '""', "'7'", "0", "1"])
def test_pages_with_a_label_attribute_of_their_own(mark):
    words = "The council met on Monday evening and agreed on a budget for the coming year, with money for the library. " * 4
    page = f"<html><body><nav><a href=x>Home</a></nav><article data-y={mark}><p>{words}</p></article></body></html>"
    want = html_extract.model().texts([page.replace(f" data-y={mark}", "")])
    assert html_extract.model().texts([page]) == want


def test_ends_without_a_beginning_cost_nothing():
    body = "<div>" * 3000 + "text " + "</section>" * 60_000 + "</b></i>" * 30_000
    began = time.time()
    page = html_extract.parse(body)
    assert time.time() - began < 5 and len(page.tag) == 3001


def test_toxicity_learns_from_long_texts_and_foreign_labels_do_not_crowd_out(spark):
    rng = np.random.default_rng(3)
    plain, bad = [f"calm{i}" for i in range(200)], ["vileword", "nastything", "grossthing"]
    text = lambda toxic, n: " ".join(np.where(rng.random(n) < (0.2 if toxic else 0), rng.choice(bad, n), rng.choice(plain, n)))
    docs = [(i, text(i % 2, 16_000 if i < 12 else 40)) for i in range(160)]
    labels = [(i, i % 2) for i in range(160)] + [(10_000 + i, i % 2) for i in range(4000)]
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), sample=60)
    got = model.scores([text(1, 30), text(0, 30), text(1, 20_000)])
    assert got[0] > 0.5 > got[1] and got[2] > 0.5
    long_only = spark.createDataFrame(docs[:12], "doc_id long, text string")
    model = toxicity.fit(long_only, spark.createDataFrame(labels[:12], "doc_id long, toxic int"))
    assert np.isfinite(model.shift)


def test_toxicity_says_when_nothing_was_learnt(spark):
    docs = spark.createDataFrame([(1, "a text")], "doc_id long, text string")
    with pytest.warns(UserWarning, match="nothing was learnt"):
        model = toxicity.fit(docs, spark.createDataFrame([(99, 1), (98, 0)], "doc_id long, toxic int"))
    assert model.scores(["a text"]).tolist() == [0.0]


def test_warc_of_other_writers(spark):
    assert warc._page("<urn:page:--5>") is None and warc._page("<urn:page:²>") is None and warc._page("<urn:page:-5>") == -5
    assert warc._page("<urn:page:99999999999999999999>") is None
    head = b"WARC/1.0\nWARC-Type: resource\nWARC-Record-ID: <urn:page:7>\nContent-Length: 12\nX-Payload-Length: abc\n\n"
    data = head + b"one\r\n\r\ntwo!!" + b"\n\n" + head.replace(b":7>", b":8>").replace(b"12", b"2") + b"ok\n\n"
    path = scratch_path(spark, "t-warc").removeprefix("file:")
    import os
    os.makedirs(path)
    for name, raw in (("a.warc", data), ("b.warc.gz", gzip.compress(data))):
        with open(f"{path}/{name}", "wb") as f:
            f.write(raw)
    got = sorted((r["page_id"], r["payload"], r["payload_length"]) for r in warc.read(spark, path, payload=True).where("file like '%a.warc'").collect())
    assert [(p, bytes(x), n) for p, x, n in got] == [(7, b"one\r\n\r\ntwo!!", None), (8, b"ok", None)]


def test_line_dedup_of_chunks_whose_hashes_collide(spark, monkeypatch):
    """One key for all chunks: each is known by its text, so nothing else goes."""
    spans = line_dedup._spans
    monkeypatch.setattr(line_dedup, "_spans", lambda least: F.transform(spans(least), lambda c: F.struct(
        F.lit(7).cast("long").alias("key"), *[c[k].alias(k) for k in ("b", "e", "text")])))
    text = " ".join(f"Sentence number {i} of a text that recurs." for i in range(40))
    rows = [(1, text), (2, "Alone it begins. " + text), (3, " ".join(f"Other words {i} are here." for i in range(40)))]
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: text, 2: "Alone it begins. ", 3: rows[2][1]}


@pytest.mark.parametrize("hot", [1, 3, 1000])
def test_meet_is_a_join(spark, monkeypatch, hot):
    """Whatever counts as hot, rows meet their groups once."""
    monkeypatch.setattr(util, "HOT", hot)
    rows = spark.createDataFrame([(k % 7 if k % 2 else 0, k) for k in range(60)] + [(None, 99), (50, 100)], "k int, v int")
    groups = util.stored(rows.where("k < 50").groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("first")), "groups")
    got = sorted(map(tuple, util.meet(rows, groups, ["k"]).select("k", "v", "first").collect()))
    assert got == sorted(map(tuple, rows.join(groups, "k").select("k", "v", "first").collect()))
    assert util.meet(rows, util.stored(groups.limit(0), "none"), ["k"]).count() == 0
