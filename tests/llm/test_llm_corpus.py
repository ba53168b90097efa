"""Phrase collocations, importance resampling, embedding near-dedup, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from mailroom.llm import collocations, embedding_dedup, importance

EXTRA = "doc_id long, text string, lang string, source string, word string, piece long, n long, k int"


def docs_of(spark, rows, schema=EXTRA):
    """rows: (doc_id, text, lang); the other columns clash with names inside."""
    return spark.createDataFrame([(i, t, g, "s", "w", 1, 2, 3) for i, t, g in rows], schema)


# --- collocations ---------------------------------------------------------------------------

def brute_collocations(rows, least, longest, covered, top):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n, f = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    able = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in able.items():
        inside = any(g == lang and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q))) and 100 * b >= covered * a
                     for (g, q), b in able.items())
        if not inside:
            s, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out.append((lang, -s, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], n[lang]))
    out.sort()
    got, rank = [], Counter()
    for lang, s, a, p, left, right, words in out:
        rank[lang] += 1
        if rank[lang] <= top:
            got.append((lang, rank[lang], p.decode(), -a, left, right, words, -s))
    return got


def phrase_rows():
    rng = random.Random(11)
    vocabulary = ["New", "York", "city", "of", "the", "State", "ünit", "É", "a b", "x\ty", "north"]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40))) + rng.choice((".", ", ", "!\n", ";;", "")) +
             " New York city hall", rng.choice(("en", "en", "de", None, "und"))) for i in range(120)]
    rows += [(1, "ha ha ha ha ha ha", "en")] * 9 + [(None, None, "en"), (3, "", None), (4, "word", "fr"), (5, " \t.,", "fr")]
    return rows + [(900, "long " * 3000 + "end", "en")]


@pytest.mark.parametrize("small", [1 << 20, 0])
def test_collocations_against_brute_force(spark, small):
    """Broadcast and shuffled semi-joins give the same phrases, exactly counted."""
    rows = phrase_rows()
    got = collocations.collocations(docs_of(spark, rows).repartition(3), least=8, covered=90, top=25, small=small).collect()
    assert sorted(map(tuple, got)) == brute_collocations(rows, 8, 5, 90, 25)


def test_collocations_exact_beyond_64_bits():
    import pyarrow as pa
    big = 3 * 10 ** 15
    b = pa.RecordBatch.from_pylist([{"lang": "en", "phrase": "x y z", "a": big, "n": 7 * 10 ** 16, "cuts": [
        {"cut": 2, "l": big + 1, "r": big + 7}, {"cut": 1, "l": big + 7, "r": big + 1}]}])
    (got,) = collocations._scores(iter([b]))
    assert got.to_pylist()[0]["score"] == 1000 * big * 7 * 10 ** 16 // ((big + 1) * (big + 7))
    assert got.to_pylist()[0]["l"] == big + 7  # a tie goes to the smallest cut


def test_collocations_empty_and_clean(spark):
    empty = docs_of(spark, [])
    got = collocations.collocations(empty)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and got.count() == 0
    assert collocations.collocations(docs_of(spark, [(1, "too few words", "en")])).count() == 0
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("occurrences_")]
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_relation_joins_without_exchange(spark):
    """The merge join reads both sides where their buckets lie."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    relations = collocations._Relations(spark, 8)
    try:
        rows = spark.range(2000).selectExpr("id div 10 as piece", "cast(id % 10 as int) as pos", "id % 3 as id")
        plan = collocations._extended(relations.persist(rows.repartition(8, "piece"), 1))._jdf.queryExecution().executedPlan().toString()
    finally:
        relations.forget()
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan


# --- importance resampling --------------------------------------------------------------------

def words(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def features(text, order):
    w = words(text)
    return [" ".join(w[i:i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)]


def brute_resample(rows, target, percent, least, order, seed):
    bucket = lambda x: zlib.crc32(x.encode()) % 10000
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(bucket, features(text, order)))
    for text in target:
        t.update(map(bucket, features(text, order)))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in s}
    out = []
    for i, text in rows:
        f = [gain[bucket(x)] for x in features(text, order)]
        weight = sum(f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    able = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for k, x in enumerate(able[:len(able) * percent // 100], 1):
        x[4] = k
    return sorted((tuple(x[:5]) for x in out), key=str)


def sample_rows():
    rng = random.Random(5)
    some = ["Alpha", "beta", "Éa", "don't", "x1", "ß", "日本", "the", "of", "a-b", "_u"]
    line = lambda: " ".join(rng.choice(some) for _ in range(rng.randint(0, 9)))
    shared = [line() for _ in range(5)] + ["", " "]
    rows = [(i, "\n".join(rng.choice((line(), rng.choice(shared))) for _ in range(rng.randint(1, 12)))) for i in range(150)]
    return rows + [(500, None), (501, ""), (502, "\n\n"), (None, "word " * 30), (7, "again " * 25), (7, "again " * 25), (600, "w " * 50_000)]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_resample_against_brute_force(spark, order):
    rows, target = sample_rows(), ["beta beta x1\nof the", None, "日本 the"]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, score long, line long, rank int").repartition(4)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(docs, goal, percent=30, least_words=20, order=order, seed=9).collect()
    assert sorted(map(tuple, got), key=str) == brute_resample(rows, target, 30, 20, order, 9)


def test_resample_lines_are_counted_once(spark):
    """Every distinct line is one row with its number, whatever texts hold it."""
    texts = spark.createDataFrame([("a b\nc",)] * 50 + [("a b\nd",)] * 7, "text string")
    got = importance.feature_counts(texts, 2)
    want = Counter()
    for text, times in (("a b\nc", 50), ("a b\nd", 7)):
        for x in features(text, 2):
            want[zlib.crc32(x.encode()) % 10000] += times
    assert {int(k): int(got[k]) for k in np.nonzero(got)[0]} == dict(want)


def test_resample_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(docs, docs.select("text")).count() == 0
    one = spark.createDataFrame([(1, "few words")], "doc_id long, text string")
    assert [tuple(r)[4] for r in importance.resample(one, docs.select("text")).collect()] == [None]


# --- embedding near-dedup -----------------------------------------------------------------------

def vector_rows(kind):
    rng = np.random.default_rng(4)
    rows, n = [], 0
    for d in (8, 64):
        for _ in range(25):
            base = rng.normal(size=d)
            for _ in range(rng.integers(1, 7)):
                v = base + rng.normal(size=d) * 0.25 * rng.choice((0, 0.5, 1)) * np.linalg.norm(base) / d ** 0.5
                rows.append((n, [kind(x) for x in v * 10.0 ** rng.integers(-3, 4)]))
                n += 1
    inf, nan = float("inf"), float("nan")
    rows += [(n, None), (n + 1, []), (n + 2, [0.0] * 8), (n + 3, [1.0] * 7 + [nan]), (n + 4, [1.0] * 7 + [inf]), (n + 5, [1.0] * 7 + [None]),
             (3, rows[3][1]), (None, rows[9][1]), (n + 6, [-0.0, 1.0]), (n + 7, [0.0, 1.0]), (None, [1.0, 0.0, 0.0])]
    return rows


def brute_dedup(rows, threshold):
    def ok(v):
        return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def cosine(v, w):
        return sum(x * y for x, y in zip(v, w, strict=True)) / math.sqrt(sum(x * x for x in v) * sum(y * y for y in w))

    link = [[j for j in range(len(rows)) if j != i and ok(v) and ok(rows[j][1]) and len(v) == len(rows[j][1]) and
             cosine(v, rows[j][1]) >= threshold] for i, (_, v) in enumerate(rows)]
    out = []
    for i, (name, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        names = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(names) if names else None
        out.append((name, len(link[i]), least, name is not None and name == least))
    return sorted(out, key=str)


@pytest.mark.parametrize("tile", [8192, 16])
def test_near_duplicates_against_brute_force(spark, tile):
    rows = vector_rows(float)
    v = spark.createDataFrame([(i, x, 1, 2, 3) for i, x in rows], "vec_id long, embedding array<double>, rep long, label int, size int").repartition(3)
    got = embedding_dedup.near_duplicates(v, 0.95, tile).collect()
    want = brute_dedup(rows, 0.95)
    assert sorted(map(tuple, got), key=str) == want
    assert sum(n for _, n, _, _ in want) > 50


def test_near_duplicates_empty(spark):
    v = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.near_duplicates(v).count() == 0


def test_quantisation_bounds_hold_and_spare_work():
    """The bound is never below the cosine, and few pairs are recomputed."""
    rng = np.random.default_rng(8)
    for d in (3, 64, 2100):
        x = rng.normal(size=(300, d))
        x[100:140] = x[:40] + rng.normal(size=(40, d)) * 0.3 / 3
        x[:, 0] *= 20 if d == 3 else 1
        u = embedding_dedup.units(x)
        q, s, big, e = embedding_dedup.quantise(u)
        exact = u @ u.T
        assert np.array_equal(embedding_dedup._product(q, q), q.astype(np.int64) @ q.T.astype(np.int64))
        near = s[:, None] * s[None, :] * (q.astype(np.int64) @ q.T.astype(np.int64))
        assert (np.abs(exact - near) <= big[:, None] * e[None, :] + e[:, None] + 1e-9).all()
        a, b, checked = embedding_dedup.tile_links(x, x, 0.95, True)
        assert set(zip(a.tolist(), b.tolist())) == {(i, j) for i, j in zip(*np.nonzero(exact >= 0.95)) if i < j}
        if d > 3:
            assert checked < 400 and len(a) >= 40
