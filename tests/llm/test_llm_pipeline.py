"""The pipeline, stage by stage, each held against its own input."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from mailroom.llm import toxicity
from mailroom.llm.util import stored, table

SMOKE = "/root/testdata/sf0.001"


def shingles(text):
    w = re.findall(r"\w+", (text or "").lower())
    n = min(5, len(w))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set()


@pytest.fixture(scope="module")
def results(spark):
    docs = table(spark, SMOKE, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], SMOKE), "test-" + name[:4]))
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages_are_the_five_in_order(results):
    assert len(corpus_pipeline.STAGES) == 5
    for df in results[:5]:
        assert df.columns == results[0].columns
    assert set(results[0].columns) <= set(results[5].columns)


def test_toxicity_stage(spark, results):
    model = toxicity.fit(results[0], table(spark, SMOKE, "labels"))
    bad = {r["doc_id"] for r in toxicity.score(results[0], model).collect() if r["predicted"]}
    assert rows(results[1]).keys() == rows(results[0]).keys() - bad


def test_line_dedup_stage(results):
    before, after = rows(results[1]), rows(results[2])
    assert before.keys() == after.keys()
    for i, r in after.items():
        assert r["n_chars"] == len(r["text"]) and (r["text"] == before[i]["text"] or len(r["text"]) < len(before[i]["text"]))
    # nothing of the corpus is lost: every long sentence is still somewhere
    cut = lambda rs: {s.strip() for r in rs.values() for s in re.split(r"(?<=\n)|(?<=[.!?] )", r["text"]) if len(s) > 60}
    assert cut(before) == cut(after)


def test_near_duplicate_stage(results):
    before, after = rows(results[2]), rows(results[3])
    sets = {i: shingles(r["text"]) for i, r in before.items()}
    group = {i: i for i in sets}
    ids = sorted(sets)
    near = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1:] if sets[a] and sets[b]
            and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    changed = True
    while changed:
        changed = False
        for a, b in near:
            low = min(group[a], group[b])
            changed |= group[a] != low or group[b] != low
            group[a] = group[b] = low
    assert after.keys() == set(group.values())


def test_decontamination_stage(spark, results):
    items = [s for r in table(spark, SMOKE, "benchmark").collect() if (s := shingles(r["text"]))]
    before, after = rows(results[3]), rows(results[4])
    dirty = {i for i, r in before.items() if any(len(s & shingles(r["text"])) >= 0.8 * len(s) for s in items)}
    assert after.keys() == before.keys() - dirty


def test_mixing_stage(results):
    before = rows(results[4])
    copies = Counter(r["doc_id"] for r in results[5].collect())
    assert copies.keys() <= before.keys() and max(copies.values()) <= 2
    words = lambda i: len(before[i]["text"].split())
    total = sum(map(words, before))
    assert abs(sum(words(i) * n for i, n in copies.items()) - 1.5 * total) < 0.1 * total
    for r in results[5].collect():
        assert r["text"] == before[r["doc_id"]]["text"]


def test_run_gives_the_last_stage(spark, results):
    got = corpus_pipeline.run(spark, SMOKE)
    key = lambda df: sorted(map(repr, df.select("doc_id", "copy", "shard", "place", "text").collect()))
    assert got.columns == results[5].columns and key(got) == key(results[5])
