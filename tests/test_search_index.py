"""Bounded search: bounds hold, blocks are skipped, hits stay; a kept index
equals one that is built anew, after any adds, deletes and compactions."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mailroom.operators import knowledge as KB
from mailroom.operators import similarity as S
from mailroom.operators import topk_kernel as K
from mailroom.operators.search_index import SearchIndex
from mailroom.session import scratch_path
from mailroom.streaming import jobs as J

CHUNK = "upload_id long, chunk_index int, content string"


def tongues(rng, n):
    """Texts in six languages, each with frequent words of its own, and two that all share."""
    out = []
    for _ in range(n):
        lang = rng.randrange(6)
        words = [f"l{lang}w{int(rng.paretovariate(0.7)) % 300}" for _ in range(rng.randint(1, 60))] + ["all", "and"][:rng.randint(0, 2)]
        out.append(" ".join(words))
    return out


def corpus(spark, seed=3, n=1500, q=60):
    rng = random.Random(seed)
    docs = [(i // 4, i % 4, t) for i, t in enumerate(tongues(rng, n))] + [(9000, 0, ""), (9001, 0, None)]
    queries = list(enumerate(tongues(rng, q))) + [(900, ""), (901, "unseen"), (902, None)]
    return spark.createDataFrame(docs, CHUNK), spark.createDataFrame(queries, "q_id long, text string")


def brute(docs, queries, k=3):
    count = lambda t: {w: t.split().count(w) for w in set(t.split())}
    have = [((u, c), count(t)) for u, c, t in docs if t]
    norm = lambda d: sum(v * v for v in d.values())
    out = []
    for q_id, text in queries:
        q = count(text or "")
        hits = []
        for key, d in have:
            dot = sum(n * d.get(w, 0) for w, n in q.items())
            if dot:
                hits.append((dot / (np.sqrt(norm(q)) * np.sqrt(norm(d))), key))
        hits.sort(reverse=True)
        out += [(q_id, r, *key, s) for r, (s, key) in enumerate(hits[:k], 1)]
    return sorted(out)


def found(df):
    return sorted(map(tuple, df.select("q_id", "rank", "upload_id", "chunk_index", "score").collect()))


def same(got, want):
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4] for g in got], [w[4] for w in want], rtol=1e-12)


def test_blocks_below_the_floor_are_skipped_and_hits_stay():
    """In one task: the same hits with and without blocks, most pairs never scored."""
    rng = random.Random(1)
    texts = tongues(rng, 1200)
    toks = [sorted(set(t.split())) for t in texts]
    ns = [[t.split().count(w) for w in ws] for t, ws in zip(texts, toks, strict=True)]
    docs = pa.table({"key": list(range(1200)), "toks": toks, "ns": ns, "n2": [sum(v * v for v in n) for n in ns]})
    small, whole = K.Postings(docs, ["key"], 32), K.Postings(docs, ["key"], 10_000)
    vocabulary = {w: i for i, w in enumerate(small.vocabulary.to_pylist())}
    queries = [t.split() for t in tongues(rng, 80)]
    q = np.concatenate([[i] * len(w) for i, w in enumerate(queries)]).astype(int)
    known = np.array([w in vocabulary for ws in queries for w in ws])
    code = np.array([vocabulary.get(w, 0) for ws in queries for w in ws])
    norm = np.array([np.sqrt(len(w)) for w in queries])
    args = q[known], code[known], np.ones(known.sum()), norm, 3
    got, want = small.best(*args), whole.best(*args)
    assert all(np.array_equal(a, b) for a, b in zip(got[:2], want[:2], strict=True)) and np.allclose(got[2], want[2])
    assert small.blocks == 38 and small.scored < 0.4 * small.bounded


def test_bounds_hold_for_every_document(spark):
    docs, queries = corpus(spark)
    index = SearchIndex(spark, scratch_path(spark, "t-index"))
    index.add(KB.kb_index(docs), 1)
    terms = KB.term_vectors(queries.repartition(4, "q_id"), ["q_id"], "text")
    reach = K.query_bounds(K.packed(terms, ["q_id"]), index.bounds(), ["q_id"])
    pairs = reach.select("q_id", "block").join(index.documents().select("upload_id", "chunk_index", "block"), "block")
    each = S.cosine_scores(pairs.select("q_id", "upload_id", "chunk_index"), terms, KB.kb_index(docs), ["q_id"], ["upload_id", "chunk_index"])
    j = each.join(index.documents().select("upload_id", "chunk_index", "block"), ["upload_id", "chunk_index"]).join(reach, ["q_id", "block"])
    assert j.where(F.col("score") > F.col("bound") * (1 + 1e-9)).count() == 0 and j.count() > 10_000


@pytest.mark.parametrize("lots", [1, 3])
def test_kept_index_finds_the_same_and_reads_fewer_blocks(spark, monkeypatch, lots):
    monkeypatch.setattr(K, "BLOCK", 32)
    docs, queries = corpus(spark)
    index = SearchIndex(spark, scratch_path(spark, "t-index"))
    index.add(KB.kb_index(docs), 1)
    asked = []
    score = K.score_pairs
    monkeypatch.setattr(K, "score_pairs", lambda pairs, *a, **k: (asked.append(pairs), score(pairs, *a, **k))[1])
    got = found(S.search(queries, index, ["q_id"], blocks=lots))
    same(got, brute(docs.collect(), queries.collect()))
    same(got, found(S.search(queries, KB.kb_index(docs), ["q_id"])))
    assert sum(p.count() for p in asked) < 0.35 * 60 * index.bounds().select("block").distinct().count()


def test_adds_deletes_and_compactions_equal_a_rebuild(spark, monkeypatch):
    rng = random.Random(5)
    queries = spark.createDataFrame(list(enumerate(tongues(rng, 25))), "q_id long, text string")
    index, live = SearchIndex(spark, scratch_path(spark, "t-index")), {}
    assert found(S.search(queries, index, ["q_id"])) == []
    for batch in range(1, 6):
        gone = rng.sample(sorted({u for u, _ in live}), min(7, len(live) // 8))
        one = rng.sample(sorted(live), min(3, len(live)))
        with monkeypatch.context() as m:  # a batch reads nothing that is stored
            for name in ("documents", "bounds", "_documents", "_tombstones"):
                m.setattr(index, name, lambda *a: pytest.fail("a batch read the stored index"))
            if gone:
                index.delete(spark.createDataFrame([(u,) for u in gone], "upload_id long"), batch)
                index.delete(spark.createDataFrame(one, "upload_id long, chunk_index int"), batch)
            fresh = {(rng.randrange(60) if rng.random() < 0.2 else 100 * batch + i, 5 * batch): t for i, t in enumerate(tongues(rng, 90))}
            terms = KB.kb_index(spark.createDataFrame([(u, c, t) for (u, c), t in fresh.items()], CHUNK))
            index.add(terms, batch)
            index.add(terms, batch)  # a replayed batch replaces itself
        live = {key: t for key, t in live.items() if not gone or key[0] not in gone and key not in one} | fresh
        if batch in (2, 4):
            index.compact()
            index.add(terms, batch)  # replayed after it went into a generation
            assert index._tombstones(["upload_id"]) is None
        same(found(S.search(queries, index, ["q_id"])), brute([(u, c, t) for (u, c), t in live.items()], [tuple(r) for r in queries.collect()]))


def test_knowledge_stream_keeps_index_and_chunks_alike(spark):
    import datetime as dt
    at = dt.datetime(2024, 1, 1)
    schema = "upload_id long, name string, file_type string, department string, content string, created_at timestamp_ntz"
    src, base = scratch_path(spark, "t-kb-src"), scratch_path(spark, "t-kb")
    index = SearchIndex(spark, f"{base}/index")

    def upload(*rows):
        spark.createDataFrame([(u, f"n{u}", "text", "general", c, at) for u, c in rows], schema).repartition(1).write.mode("append").parquet(src)

    def run():
        q = J.stream_knowledge(J.file_stream(spark, src, spark.createDataFrame([], schema).schema), f"{base}/chunks", index, f"{base}/ck")
        q.awaitTermination()
        assert q.exception() is None

    upload((1, "zebra stripes"), (2, "lion mane " * 900), (3, "zebra"))
    run()
    upload((1, None), (4, "lion zebra"))
    run()
    upload((1, "zebra again"), (2, None))
    run()
    run()  # nothing new
    one = KB.chunk(spark.createDataFrame([], schema)).schema
    chunks = J.live_chunks(spark, f"{base}/chunks", one)
    assert sorted(r.upload_id for r in chunks.collect()) == [1, 3, 4]
    queries = spark.createDataFrame([(1, "zebra"), (2, "lion mane"), (3, "stripes")], "q_id long, text string")
    got = found(S.search(queries, index, ["q_id"]))
    same(got, found(S.search(queries, KB.kb_index(chunks), ["q_id"])))
    assert [g[:4] for g in got] == [(1, 1, 3, 0), (1, 2, 4, 0), (1, 3, 1, 0), (2, 1, 4, 0)]


def test_queries_move_as_compressed_bundles(spark):
    """A query goes to every shard: as a bundle with its neighbours it takes a part of its terms' bytes, and comes back whole."""
    import pyarrow as pa

    rng = random.Random(3)
    words = ["w%d" % i for i in range(3000)]
    rows = [(i, [rng.choice(words) for _ in range(40)]) for i in range(2000)] + [(9000, ["", "é", "ΟΔΟΣ"]), (9001, [])]
    packed = spark.createDataFrame([(i, t, [1] * len(t), len(t)) for i, t in rows], "q_id long, toks array<string>, ns array<long>, n2 long").repartition(2, "q_id")
    made = K.bundled(packed, ["q_id"]).toArrow()
    assert made.nbytes < 0.35 * packed.toArrow().nbytes
    back = pa.concat_tables(K._unbundled(made)).select(["q_id", "toks", "ns", "n2"])
    assert sorted(back.to_pylist(), key=lambda r: r["q_id"]) == sorted(packed.toArrow().to_pylist(), key=lambda r: r["q_id"])


def test_a_kept_search_writes_nothing_for_a_query_and_a_block(spark, monkeypatch):
    """Twice the blocks: what the search writes stays as it is, and the pass over all documents shuffles nothing."""
    monkeypatch.setattr(K, "BLOCK", 16)
    docs, queries = corpus(spark)
    index = SearchIndex(spark, scratch_path(spark, "t-index"))
    index.add(KB.kb_index(docs), 1)
    blocks = index.bounds().select("block").distinct().count()
    wrote, plans = [], []
    keep, meet = K.written, K.score_bundles
    monkeypatch.setattr(K, "written", lambda df, name: (t := keep(df, name), wrote.append(t.count()))[0])
    monkeypatch.setattr(K, "score_bundles", lambda *a: (t := meet(*a), plans.append(t._jdf.queryExecution().sparkPlan().toString()))[0])
    got = found(S.search(queries.unionByName(spark.createDataFrame([(None, "all and")], "q_id long, text string")), index, ["q_id"]))
    same(got, brute(docs.collect(), queries.collect()))
    assert blocks > 90 and sum(wrote) < 60 * blocks / 10
    assert plans and "Exchange" not in plans[0] and "NestedLoop" in plans[0] + plans[0].replace("CartesianProduct", "NestedLoop")


def test_known_floors_change_no_hit_at_or_above_them():
    rng = random.Random(4)
    texts = tongues(rng, 300)
    toks = [sorted(set(t.split())) for t in texts]
    ns = [[t.split().count(w) for w in ws] for t, ws in zip(texts, toks, strict=True)]
    p = K.Postings(pa.table({"key": list(range(300)), "toks": toks, "ns": ns, "n2": [sum(v * v for v in n) for n in ns]}), ["key"], 32)
    vocabulary = {w: i for i, w in enumerate(p.vocabulary.to_pylist())}
    queries = [[w for w in t.split() if w in vocabulary] for t in tongues(rng, 40)]
    q = np.concatenate([[i] * len(w) for i, w in enumerate(queries)]).astype(int)
    args = q, np.array([vocabulary[w] for ws in queries for w in ws]), np.ones(len(q)), np.array([np.sqrt(max(1, len(w))) for w in queries]), 3
    all_q, all_doc, all_score = p.best(*args)
    floor = np.array([rng.choice((0.0, *all_score[all_q == i], 2.0)) for i in range(40)])
    before = p.scored
    got = p.best(*args, floor)
    fit = all_score >= floor[all_q]
    assert np.array_equal(got[0], all_q[fit]) and np.array_equal(got[1], all_doc[fit]) and p.scored - before < before


def test_documents_in_bundles_are_scored_against_floors_of_earlier_ones(spark, monkeypatch):
    """A shard's documents come as compressed bundles that are opened a few at a time; hits,
    ties between bundles included, equal a search of all at once, also beyond single precision."""
    monkeypatch.setattr(K, "_DOCUMENTS", 40)
    rng = random.Random(8)
    texts = tongues(rng, 200)
    texts[150:160] = texts[20:30]  # ties: the larger key wins
    counts = [{w: t.split().count(w) for w in sorted(set(t.split()))} for t in texts]
    counts[7] = {w: 5000 * n for w, n in counts[7].items()}
    rows = [(i, list(c), list(c.values()), sum(v * v for v in c.values())) for i, c in enumerate(counts) if c]
    docs = spark.createDataFrame(rows, "key long, toks array<string>, ns array<long>, n2 long")
    asked = docs.withColumnRenamed("key", "q_id")
    schema = pa.schema([("q_id", pa.int64()), ("key", pa.int64()), ("score", pa.float64())])
    bundles = [K.bundled(docs.where(F.col("key") % 5 == i).coalesce(1), ["key"]).toArrow() for i in range(5)]
    run = K._scorer(["q_id"], ["key"], 3, schema)
    hits = run(pa.concat_tables(bundles), K.bundled(asked.coalesce(1), ["q_id"]).toArrow()).to_pylist()
    whole = K.Postings(docs.toArrow(), ["key"])
    want = K._scored(["q_id"], 3, schema)(whole, *K._plain(asked.toArrow())).to_pylist()
    best = lambda found: sorted((q, *h) for q in {f["q_id"] for f in found} for h in sorted(
        ((f["score"], f["key"]) for f in found if f["q_id"] == q), reverse=True)[:3])
    assert best(hits) == best(want) and len(want) == 3 * len(rows)
    assert len(hits) < 4 * len(want)  # what cannot be among the hits stays in its task


def test_a_shard_takes_documents_as_bundles(spark):
    docs, queries = corpus(spark, n=300, q=10)
    p = S.search(queries, KB.kb_index(docs), ["q_id"], shards=4)._jdf.queryExecution().executedPlan().toString()
    assert p.count("MapInArrow") >= 2  # both sides of the cogroup


def test_searches_share_what_is_made_of_an_unchanged_index(spark, monkeypatch):
    """Bundles and leading blocks are written once for each state of the index."""
    from mailroom.operators import search_index as X

    docs, queries = corpus(spark, n=200, q=10)
    index, wrote = SearchIndex(spark, scratch_path(spark, "t-index")), []
    keep = X.written
    monkeypatch.setattr(X, "written", lambda df, name: (wrote.append(name), keep(df, name))[1])
    index.add(KB.kb_index(docs), 1)
    first = found(S.search(queries, index, ["q_id"]))
    assert sorted(wrote) == ["search-held", "search-leading"] and found(S.search(queries, index, ["q_id"])) == first and len(wrote) == 2
    index.delete(docs.where("upload_id % 2 = 0").select("upload_id"), 2)
    left = found(S.search(queries, index, ["q_id"]))
    same(left, brute(docs.where("upload_id % 2 = 1").collect(), queries.collect()))
    assert wrote.count("search-held") == 2  # tombstones change the live documents
    index.compact()
    assert found(S.search(queries, index, ["q_id"])) == left


def test_blocks_keep_to_a_tongue_though_rare_words_weigh_most(spark):
    """A document lies with others by a token that many hold, not by a rare one that it repeats."""
    toks = [[f"rare{i}", f"tongue{i % 4}"] for i in range(64)]
    p = K.Postings(pa.table({"key": list(range(64)), "toks": toks, "ns": [[9, 2]] * 64, "n2": [85] * 64}), ["key"], 16)
    assert all(len({i % 4 for i in p.side[16 * b:16 * b + 16]}) == 1 for b in range(4))
