"""Search by trigrams equals the scan."""

import random

import numpy as np
import pytest

from mailroom.operators import listing as L
from mailroom.operators import substring_index as X
from mailroom.operators.substring_index import SubstringIndex, literal_grams
from mailroom.session import scratch_path

DDL = "id string, subject string, sender_email string, sender_name string, status string"
TEXTS = ["order", "ORDER", "rder 1", "or", "", "o%r", "ord_r", "%der%", "ord%ice", "zzz", "a\\b", "100%", "İstanbul", "ΟΔΟΣ", "straße", "line\nbreak",
         "order 12", "anna@", "no such words here", "___", "der 7 in%ice"]


def rows_of(rng, n, start=0):
    words = ["Order", "invoice", "İSTANBUL", "ΟΔΟΣ", "Straße", "a\\b", "100% sure", "line\nbreak", "re: order"]
    some = lambda: " ".join(f"{rng.choice(words)} {rng.randint(0, 20)}" for _ in range(rng.randint(0, 4)))
    maybe = lambda x: None if rng.random() < 0.1 else x
    return [(f"m{start + k}", maybe(some()), maybe(f"Anna{k % 9}@example.org"), maybe(some()), rng.choice(("sent", "new"))) for k in range(n)]


@pytest.fixture(scope="module")
def index(spark):
    rng = random.Random(8)
    rows = [rows_of(rng, 150), rows_of(rng, 60, 150), [("long", "x" * 20000 + " order 12 in the end", "", None, "sent"), ("e", "", "", "", "new")]]
    idx = SubstringIndex(spark, scratch_path(spark, "grams"), buckets=16)
    for b, r in enumerate(rows):
        idx.add(spark.createDataFrame(r, DDL), b)
    idx.add(spark.createDataFrame(rows[1], DDL), 1)  # a replay
    return idx, spark.createDataFrame(sum(rows, []), DDL).cache()


def test_search_equals_the_scan(index):
    idx, emails = index
    found = 0
    for text in TEXTS:
        want = sorted(r.id for r in L.list_filter(emails, search=text).select("id").collect())
        assert sorted(r.id for r in idx.search(emails, text).select("id").collect()) == want, text
        found += 0 < len(want) < emails.count()
    assert found >= 10
    want = L.list_filter(emails, status="new", search="order 12").count()
    assert idx.search(emails, "order 12", status="new").count() == want


def test_a_search_reads_the_buckets_of_its_grams(spark, index):
    idx, _ = index
    p = idx._of("postings", "gram string, field int, id string, bucket int, batch int", ["ord"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in p or "PartitionFilters: [(bucket" in p
    assert "gram" in p.split("PushedFilters: ")[1].split("]")[0]
    n = idx._read("postings", "gram string, field int, id string, bucket int, batch int").where("batch = 1")
    assert n.count() == n.distinct().count()


def test_index_without_batches_and_short_texts(spark):
    idx = SubstringIndex(spark, scratch_path(spark, "no-grams"))
    emails = spark.createDataFrame(rows_of(random.Random(1), 5), DDL)
    assert idx.search(emails, "order").count() == 0
    assert idx.search(emails, "or").count() == L.list_filter(emails, search="or").count()
    idx.add(emails.limit(0), 1)
    assert idx.search(emails, "order").count() == 0


def test_literal_grams():
    assert literal_grams("ab%cde_fghi") == ["cde", "fgh", "ghi"]
    assert literal_grams("a_b%") == []


def test_numbers_come_back_from_their_gaps():
    rng = random.Random(3)
    runs = [sorted(rng.sample(range(X.BLOCK), rng.choice((1, 2, 40, X.BLOCK)))) for _ in range(60)] + [[0], [127], [128], [0, 128, 4095]]
    start = np.cumsum([0, *map(len, runs[:-1])])
    assert [X._numbers(b).tolist() for b in X._packed(start, np.concatenate(runs))] == runs
    assert X._grams(["aaaa", None, "", "ab", "aab", "𝒳𝒴𝒵a"])[0] == ["aaa", "aab", "𝒳𝒴𝒵", "𝒴𝒵a"]


def test_postings_are_one_row_for_a_gram_and_block_and_rows_do_not_move(spark, monkeypatch):
    rows = [(f"m{i}", f"order the {i % 7}", f"anna{i}@example.org", None if i % 5 else "", "new") for i in range(3000)]
    emails = spark.createDataFrame([*rows, *rows[:50], (None, "the", "", "", "new")], DDL).repartition(2)
    idx = SubstringIndex(spark, scratch_path(spark, "grams"), buckets=8)
    idx.add(emails, 1)
    stored = idx._read("postings", X._POSTINGS).where("bucket >= 0")
    held = stored.selectExpr("count(*)", "sum(n)", "sum(octet_length(at))").first()
    assert held[1] > 80_000 and held[0] < held[1] / 8 and held[2] < 1.2 * held[1]
    late = spark.createDataFrame([("late", "the last", "", "", "new")], DDL)
    for few in (0, X.FEW):  # candidates that are many, and few
        monkeypatch.setattr(X, "FEW", few)
        for text in ("the", "the 3", "anna12", "%rde%the 6"):
            got = idx.search(emails.union(late), text)
            assert sorted(r.id for r in got.collect()) == sorted(r.id for r in L.list_filter(emails.where("id is not null"), search=text).collect())
    monkeypatch.setattr(X, "FEW", 100)  # 3,050 candidates, one stranger
    plan = idx.search(emails.union(late), "the")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
