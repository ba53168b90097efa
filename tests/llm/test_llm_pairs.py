"""Operators on word shingles: Jaccard join, decontamination, line dedup."""

import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from mailroom.llm import components, decontaminate, jaccard_join, line_dedup, queries, words

SMOKE = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, prefix string, rep long, rank int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", 5, 1) for i, t in rows], SCHEMA)


def shingles(text):
    w = re.findall(r"\w+", (text or "").lower())
    n = min(5, len(w))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set()


def prose(rng, n):
    return " ".join(rng.choice(("alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa")) + str(rng.randint(0, 40)) for _ in range(n))


def near_docs():
    rng = random.Random(3)
    rows, n = [], 0
    for group in range(12):
        base = prose(rng, rng.choice((12, 40, 120, 400))).split()
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = "changed" + str(rng.randint(0, 9))
            rows.append((n, " ".join(w)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, "short text"), (n + 3, "Short, text!"), (n + 4, " \n"), (0, rows[0][1])]
    return rows


def brute_join(rows):
    sets = [shingles(t) for _, t in rows]
    link = [[k for k in range(len(rows)) if k != j and sets[j] and sets[k] and
             len(sets[j] & sets[k]) / len(sets[j] | sets[k]) >= 0.8] for j in range(len(rows))]
    out = []
    for j, (i, _) in enumerate(rows):
        seen, todo = {j}, [j]
        while todo:
            for k in link[todo.pop()]:
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        copies = 1 + sum(sets[k] == sets[j] for k in link[j])
        out.append((i, min(rows[k][0] for k in seen), len(link[j]), copies))
    return sorted(out)


@pytest.mark.parametrize("block", [2048, 8])
def test_jaccard_join_equals_brute_force(spark, block):
    """Small blocks cut groups into several tasks; the result stays."""
    rows = near_docs()
    got = jaccard_join.jaccard_join(docs_of(spark, rows), block=block).collect()
    assert sorted(map(tuple, got)) == brute_join(rows)


def test_jaccard_join_of_nothing(spark):
    assert jaccard_join.jaccard_join(docs_of(spark, [])).collect() == []
    got = jaccard_join.jaccard_join(docs_of(spark, [(None, "a b c d e f"), (None, "a b c d e f"), (4, None)])).collect()
    assert sorted(tuple(r)[1:] for r in got if r[0] is None) == [(None, 1, 2), (None, 1, 2)]
    assert [tuple(r) for r in got if r[0] == 4] == [(4, 4, 0, 1)]


def test_one_of_each_keeps_one(spark):
    rows = [*near_docs(), (None, "no id here"), (None, None)]
    got = jaccard_join.one_of_each(docs_of(spark, rows))
    named = sorted(r["doc_id"] for r in got.collect() if r["doc_id"] is not None)
    assert named == sorted({c for _, c, _, _ in brute_join(rows[:-2])})
    assert got.where("doc_id is null").count() == 2 and got.columns == docs_of(spark, []).columns


def test_prefix_is_shortened_until_recall():
    d = jaccard_join.prefix_length(0.8, 32, 5, jaccard_join.RECALL)
    assert d == 4 and 1 - (1 - 0.8 ** d) ** 32 >= jaccard_join.RECALL > 1 - (1 - 0.8 ** (d + 1)) ** 32
    with pytest.raises(ValueError):
        jaccard_join.prefix_length(0.1, 2, 5, 0.999)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (300, 299)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[k] == 100 for k in range(100, 160)) and got[300] == got[299] == 299


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(5)
    items = [(k, prose(rng, n)) for k, n in enumerate((3, 5, 9, 15, 30, 57, 57))] + [(50, None), (51, ""), (None, prose(rng, 20))]
    items.append((60, items[4][1]))
    rows = []
    for i in range(60):
        w = prose(rng, rng.choice((0, 3, 30, 3000))).split()
        k, t = rng.choice(items[:7])
        part = t.split()
        for _ in range(rng.randint(0, 3)):
            part[rng.randrange(len(part))] = "other"
        at = rng.randint(0, len(w))
        rows.append((i, " ".join(w[:at] + part + w[at:])))
    rows += [(100, None), (101, ""), (7, rows[7][1]), (None, items[4][1].upper()), (102, items[0][1])]
    bench = spark.createDataFrame([(k, t, "clash") for k, t in items], "item_id long, text string, doc_id string")
    want = sorted(((i, k, len(shingles(t) & s), len(s)) for i, t in rows for k, x in items if (s := shingles(x))
                   and len(shingles(t) & s) / len(s) >= 0.8), key=repr)
    for block in (decontaminate.BLOCK, 60):  # one block of items, and many
        got = decontaminate.contained(docs_of(spark, rows), bench, block=block).collect()
        assert sorted((tuple(r)[:4] for r in got), key=repr) == want
    clean = decontaminate.clean(docs_of(spark, rows), bench, block=60)
    dirty = {t for i, t in rows if any(x[0] == i for x in want)}
    assert sorted(r["text"] or "" for r in clean.collect()) == sorted(t or "" for _, t in rows if t not in dirty)
    assert decontaminate.contained(docs_of(spark, rows), bench.limit(0)).count() == 0
    assert decontaminate.contained(docs_of(spark, []), bench).count() == 0


def test_sketch_length_leaves_no_gap():
    """More sketch values than shingles that may be missing, at any size."""
    for n in range(1, 400):
        missing = max(m for m in range(n + 1) if (n - m) / n >= 0.8)
        assert decontaminate.sketch_length(decontaminate.size_partition(n)) > missing


def brute_line_dedup(spark, rows, min_words=line_dedup.MIN_WORDS, reach=line_dedup.REACH):
    """Chunks as the operator's docstring has them, kept at first occurrence."""
    cut = line_dedup.chunked(spark.createDataFrame(rows, "doc_id long, text string").where("text <> ''"))
    lines, first, gone = {}, {}, {}
    bare = lambda x: x.rstrip("\n").rstrip(" ") if not x.endswith(" ") else x.rstrip("\n ")
    docs = sorted(cut.collect(), key=lambda r: r["doc_id"])
    for r in docs:
        i, ends = r["doc_id"], r["_ld_ends"]
        lines[i] = r["_ld_lines"]
        assert "".join(lines[i]) == r["text"] and ends[-1] == len(lines[i])
        assert all(b - a > 1 for a, b in zip([0, *ends][1:-2], ends[1:-1], strict=False))
        for a, b in zip([0, *ends], ends, strict=False):
            key = "".join(lines[i][a:b]).rstrip(" \n")
            if b - a < 2 or len(key.split()) < min_words:
                continue
            if key not in first:
                first[key] = (i, a, b)
                continue
            k, c, d = first[key]
            low = high = 0
            same = lambda x, y: bare(x) == bare(y)
            while low < reach and a - low > 0 and c - low > 0 and same(lines[i][a - low - 1], lines[k][c - low - 1]):
                low += 1
            while high < reach and b + high < len(lines[i]) and d + high < len(lines[k]) and same(lines[i][b + high], lines[k][d + high]):
                high += 1
            gone.setdefault(i, set()).update(range(a - low, b + high))
    return {i: t if not t else "".join(x for n, x in enumerate(lines[i]) if n not in gone.get(i, ())) for i, t in rows}


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(9)
    sentence = lambda: prose(rng, rng.randint(3, 12)).capitalize() + ". "
    passages = ["".join(sentence() for _ in range(rng.randint(5, 14))) for _ in range(3)]
    rows = []
    for i in range(40):
        parts = ["".join(sentence() for _ in range(rng.randint(1, 6))) + "\n" for _ in range(rng.randint(1, 5))]
        for _ in range(rng.randint(0, 2)):
            parts.insert(rng.randint(0, len(parts)), prose(rng, 3) + " " + rng.choice(passages) + prose(rng, 2))
        rows.append((i, "".join(parts)))
    rows += [(100, None), (101, ""), (102, "one line"), (103, rows[3][1])]
    got = line_dedup.line_dedup(docs_of(spark, rows))
    assert {r["doc_id"]: r["text"] for r in got.collect()} == brute_line_dedup(spark, rows)
    assert got.where("n_chars <> length(text)").count() == 0
    left = "".join(r["text"] or "" for r in got.collect())
    before = "".join(t or "" for _, t in rows)
    for p in passages:  # most of what a shared passage repeats is gone, and one copy is left
        inner = [x for x in re.split(r"(?<=\. )", p) if x][1:]
        assert all(x in left for x in inner)
        assert sum(left.count(x) - 1 for x in inner) <= 0.3 * sum(before.count(x) - 1 for x in inner)


def test_line_dedup_of_repeats_and_nothing(spark):
    text = " ".join(f"This is sentence number {i} of a text that recurs." for i in range(12))
    rows = [(1, text), (1, text), (None, text), (2, "Alone. Here.")]
    got = line_dedup.line_dedup(docs_of(spark, rows)).collect()
    assert len(got) == 4 and sum(len(r["text"]) for r in got if r["text"].startswith("This")) >= len(text)
    assert next(r["text"] for r in got if r["doc_id"] is None) == text  # sorts first, so it is the one kept whole
    assert line_dedup.line_dedup(docs_of(spark, [])).count() == 0


def long_runs_gone(rows, least=51):
    """Lines in a run of over 50 words that an earlier place holds, by comparing
    every run of non-blank lines with all others."""
    lines = {i: re.split(r"(?<=\n)|(?<=[.!?] )", t) for i, t in rows}
    full = {i: [(k, x.strip()) for k, x in enumerate(v) if x.strip()] for i, v in lines.items()}
    seen, gone = set(), {i: set() for i in lines}
    for i in sorted(full):
        for b in range(len(full[i])):
            for e in range(b + 1, len(full[i]) + 1):
                run = tuple(x for _, x in full[i][b:e])
                if sum(len(x.split()) for x in run) < least:
                    continue
                if run in seen:
                    gone[i].update(range(full[i][b][0], full[i][e - 1][0] + 1))
                seen.add(run)
    return lines, gone


def long_passages(rng, count, lines):
    """Rows of own lines, and ``count`` passages of 51 to 100 words in that many
    lines, each pasted into three of them."""
    sentence = lambda n: prose(rng, n).capitalize() + ". "
    rows = [["".join(sentence(rng.randint(3, 9)) for _ in range(rng.randint(2, 5))) + "\n" for _ in range(6)] for _ in range(30)]
    for _ in range(count):
        words, n = rng.randint(51, 100), rng.choice(lines)
        passage = "".join(sentence(words // n + (k < words % n)) for k in range(n)) + "\n"
        for r in rng.sample(rows, 3):
            r.insert(rng.randint(0, len(r)), passage)
    return [(i, "".join(r)) for i, r in enumerate(rows)]


@pytest.mark.parametrize("lines", [(2, 3, 4, 5, 6, 8, 12), (1,)])
def test_line_dedup_finds_every_long_run(spark, lines):
    """No line stays that is in a run of over 50 words and has an earlier place."""
    rows = long_passages(random.Random(17), 40, lines)
    cut, gone = long_runs_gone(rows)
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(docs_of(spark, rows)).collect()}
    assert sum(map(len, gone.values())) >= 60
    for i, _ in rows:  # the passages are all that recurs here, so nothing else goes
        stay = [x.strip() for k, x in enumerate(cut[i]) if k not in gone[i] and x.strip()]
        assert [x.strip() for x in re.split(r"(?<=\n)|(?<=[.!?] )", got[i]["text"]) if x.strip()] == stay
        assert got[i]["n_removed"] >= sum(1 for k in gone[i] if cut[i][k].strip())


def test_line_dedup_grows_until_lines_differ(spark):
    """Of passages of 48 words in 12 lines, a later copy goes as a whole if a chunk of it does."""
    rng = random.Random(23)
    sentence = lambda n: prose(rng, n).capitalize() + ". "
    passages = [[sentence(4) for _ in range(12)] for _ in range(20)]
    rows = [(i, sentence(6) + sentence(5) + "".join(passages[i % 20]) + sentence(7) + sentence(6)) for i in range(60)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(docs_of(spark, rows)).collect()}
    left = [sum(x in got[i] for x in passages[i % 20]) for i in range(20, 60)]
    assert all(got[i] == rows[i][1] for i in range(20))
    assert set(left) <= {0, 12} and left.count(0) >= 30


def test_line_dedup_goes_on_with_lines_that_recur_only(spark):
    """Of all lines, those of the passages that are pasted three times make windows, and no others."""
    rows = long_passages(random.Random(29), 10, (4, 6, 8))
    texts = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_ld_row", F.col("doc_id"))
    runs = line_dedup._runs(texts, line_dedup.MIN_WORDS)
    cut, _ = long_runs_gone(rows)
    seen = Counter(x.strip() for v in cut.values() for x in v if x.strip())
    again = sum(n for n in seen.values() if n > 1)
    assert 100 < again <= sum(len(r["_ld_hash"]) for r in runs.collect()) < 2 * again < sum(seen.values())
    alone = texts.where("doc_id < 0").union(spark.createDataFrame([(1, "".join(f"Own sentence {i}. " for i in range(60)), 1)], texts.schema))
    assert line_dedup._runs(alone, line_dedup.MIN_WORDS).count() == 0


def test_line_dedup_with_a_full_bitmap(spark, monkeypatch):
    """A bitmap too small to tell lines or rows apart lets all through, and the result stays."""
    rows = long_passages(random.Random(31), 10, (1, 3, 6, 12)) + [(100, "Two  spaces.\tAnd a tab. \n \n"), (101, ""), (102, None)]
    whole = sorted(map(tuple, line_dedup.line_dedup(docs_of(spark, rows)).collect()))
    monkeypatch.setattr(line_dedup, "MOST_BITS", 64)
    assert sorted(map(tuple, line_dedup.line_dedup(docs_of(spark, rows)).collect())) == whole
    assert sum(r[-1] for r in whole) > 20


def test_words_of_a_line(spark):
    lines = ["", "\n", " ", "\t\n", "one", " one two.\n", "a  b", "a\tb c", "a \x0b b\n", "\u00e4\u00a0\u00f6 \u00fc ", "a\r\n", "x " * 60]
    got = spark.createDataFrame([(x,) for x in lines], "x string").select(line_dedup._n_words(F.col("x")).alias("n")).collect()
    assert [r["n"] for r in got] == [len(re.findall(r"[^ \t\n\x0b\f\r]+", x)) for x in lines]


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"create view {t} as select * from '{SMOKE}/{t}.parquet'")
    want = con.sql(queries.ORACLE[name]).df()
    got = queries.QUERIES[name](spark, SMOKE).toPandas()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    rows = lambda d: sorted(map(repr, d[cols].astype(object).where(d[cols].notna(), None).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_shingles_agree_with_plain_python():
    for text in (None, "", "One", "a B c", "The quick brown fox jumps over the lazy dog", "é ü ß " * 7):
        assert len(words.shingle_set(text)) == len(shingles(text))
