"""Operators that work row by row, and the mixing plan."""

import gzip
import hashlib
import io
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailroom.llm import chat_format, html_extract, labelled_pages, mixing, secrets_scan, topk_search, toxicity, warc
from mailroom.llm import queries
from mailroom.session import scratch_path

SMOKE = "/root/testdata/sf0.001"


# --- secrets ---------------------------------------------------------------------

def brute_base(text):
    """The contract, one kind after the other, with its literal patterns."""
    text, spans = text or "", []
    low = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    for m in re.finditer(low + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m.group(2)) >= 12:
            spans.append((m.start(), 0, m.end()))
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 16]
    return sorted(spans)


def test_secret_scan(spark):
    rng = random.Random(1)
    own, shared = "Zx9Q" + "aB3" * 9, "Ex4M" + "pL3" * 9
    rows = [(0, f"é key {own} and secret = 'abcdef123456789'", "a"), (1, f"see {shared}", "a"), (2, f"copy {shared}", "b"), (3, f"copy {shared}", None),
            (4, None, "a"), (5, "", "b"), (6, "PASSWORD: hunter2hunter2 tokEn=AKIA" + "A1" * 10 + " 0123456789abcdef0", "a"), (7, "token: token=abcdefghijkl", "c"),
            (8, "AKIA" + "B" * 13 + " AKIAAKIA" + "C" * 12, "c"), (9, "api_key=" + "x" * 11 + " apikey : " + "y" * 12, "c"), (9, f"twice {own}", "a")]
    pieces = ["token", "=", " ", '"', "AKIA", "ABCDEF123", "deadbeef", "0123", "secret", ":", "zz", "ſecret", "paK"]
    rows += [(100 + i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 60))), "r") for i in range(300)]
    df = spark.createDataFrame([(i, t, s, "en", "clash") for i, t, s in rows], "doc_id long, text string, source string, lang string, owner string")
    got = {(r["doc_id"], r["spans"]): r for r in secrets_scan.scan(df).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        base = brute_base(t)
        line = lambda s: ",".join(f"{secrets_scan.KINDS[k]}:{a}:{b}" for a, k, b in s)
        r = next(r for (d, s), r in got.items() if d == i and set(line(base).split(",") if base else []) <= set(s.split(",")) and
                 r["base_sha256"] == hashlib.sha256(line(base).encode()).hexdigest())
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == n for _, k, _ in base) for n in range(3)]
    spans = {d: s for d, s in got}
    assert "live:6:" in next(s for d, s in got if d == 0) and "live" not in spans[1] + spans[2] + spans[3]
    assert secrets_scan.scan(df.limit(0)).count() == 0


# --- top-k -----------------------------------------------------------------------

def test_topk_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = (rng.normal(0, 0.2, (700, 24)) * rng.choice([1, 1, 3], (700, 1))).astype(np.float32)
    x[10], x[11] = x[12], x[12]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(700, None), (800, [None] * 24), (900, [float("nan")] * 24), (1000, [float("inf")] * 24), (1100, []), (1200, [0.5] * 3), (1300, [0.25] * 3),
             (None, [0.1] * 24), (3, rows[3][1]), (100, rows[100][1])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, v int, g int")
    monkeypatch.setattr(topk_search, "GROUP", 100)
    monkeypatch.setattr(topk_search, "QUERIES", 3)
    got = sorted(map(tuple, topk_search.search(df, df.where("vec_id % 100 = 0"), 10).collect()))
    ok = [(i, np.floor(1024 * np.array(v, np.float64)).astype(np.int64)) for i, v in rows
          if i is not None and v and all(c is not None and np.isfinite(c) for c in v)]
    want = []
    for q, qv in {i: v for i, v in ok if i % 100 == 0}.items():
        best = sorted((-int(qv @ v), i) for i, v in ok if i != q and len(v) == len(qv))[:10]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert topk_search.search(df.limit(0), df.limit(0), 10).count() == 0


def test_topk_drops_candidates_only_below_the_floor():
    rng = np.random.default_rng(6)
    x, y = rng.integers(-900, 900, (5000, 32)), rng.integers(-900, 900, (7, 32))
    x[:, 8:] //= 30  # nearly all mass in the first block, so later blocks see few candidates
    who, ids, score = topk_search.top_k(np.arange(5000), x, np.full(7, -1), y, 5)
    full = y @ x.T
    for j in range(7):
        want = sorted((-int(full[j, i]), i) for i in range(5000))[:5]
        assert sorted((-int(s), int(i)) for w, i, s in zip(who, ids, score, strict=True) if w == j) == want
    with pytest.raises(OverflowError):
        topk_search.top_k(np.arange(2), np.full((2, 2), 2 ** 33), np.array([9]), np.full((1, 2), 2 ** 33), 1)


# --- WARC ------------------------------------------------------------------------

def test_warc_round_trip_and_pushdown(spark):
    long = "ü" * 600
    rows = [(1, "http://a/1", long), (2, "http://a/2", long), (9, None, long), (3, "x\r\ny", "short"), (4, "u", "short"), (5, "u", None),
            (6, "u", "a\r\n\r\nb\0c" + "z" * 2000), (None, "u", long), (None, "n", "only " * 300), (9, "again", long)]
    pages = spark.createDataFrame([(i, u, h, "clash") for i, u, h in rows], "page_id long, url string, html string, last string")
    path = scratch_path(spark, "warc-test")
    warc.archive(pages, path)
    got = warc.read(spark, path, payload=True).collect()
    assert len(got) == len(rows)
    for r in got:
        same = [h or "" for i, u, h in rows if i == r["page_id"] and (u or "").replace("\r", "%0D").replace("\n", "%0A") == r["url"]]
        data = same[0].encode()
        assert r["payload_digest"] == hashlib.sha1(data).hexdigest() and r["payload_length"] == len(data)
        again = same[0] == long and r["page_id"] != 9
        assert (r["record_type"], r["refers_to"]) == (("revisit", 9) if again else ("response", None))
        assert r["payload"] == (None if again else data)
    revisits = warc.read(spark, path).where("record_type = 'revisit' AND page_id >= 2")
    assert [r["page_id"] for r in revisits.collect()] == [2]
    assert warc.read(spark, path).where("url IN ('u') AND page_id IS NULL").count() == 1
    empty = scratch_path(spark, "warc-none")
    warc.archive(pages.limit(0), empty)
    assert warc.read(spark, empty).count() == 0


def test_warc_reads_other_writers_files_and_skips_blocks():
    recs = [warc.record("response", i, "u", None, "ab", 5, b"x" * (5 + 70_000 * (i == 1)), "d") for i in range(3)]
    plain = list(warc.plain_records(io.BytesIO(b"".join(recs))))
    assert [r.head["warc-record-id"] for r in plain] == [f"<urn:page:{i}>" for i in range(3)]
    foreign = b"".join(gzip.compress(r) for r in recs)
    own = b"".join(warc.member(r) for r in recs)
    assert gzip.decompress(own) == b"".join(recs)  # members of any gzip reader
    for data in (foreign, own):
        f = io.BytesIO(data)
        assert [len(r.block()) for r in warc.gzip_records(f)] == [int(r.head["content-length"]) for r in plain]
        assert len(list(warc.gzip_records(io.BytesIO(data)))) == 3  # no block asked for
    seen = []
    inflate = zlib.decompressobj

    class Counting:
        def __init__(self, *a):
            self.z = inflate(*a)

        def decompress(self, data, *a):
            out = self.z.decompress(data, *a)
            seen.append(len(out))
            return out

        def __getattr__(self, name):
            return getattr(self.z, name)

    warc.zlib.decompressobj = Counting
    try:
        list(warc.gzip_records(io.BytesIO(own)))
    finally:
        warc.zlib.decompressobj = inflate
    assert sum(seen) < 15_000  # of over 70,000 bytes


# --- HTML ------------------------------------------------------------------------

def test_marginals_are_exact():
    """Sum-product on a small tree equals the sum over all labellings."""
    m = html_extract.model()
    page = html_extract.parse("<body><div class=ad>x<p>y</p></div><article><h1>t</h1><p>One, two. Three</body>")
    forest = html_extract.Forest([page], m.vocabulary)
    p, _ = forest.marginals(m.weight, m.pair)
    n = len(page.parent)
    own = np.bincount(forest.owner, weights=m.weight[forest.flat], minlength=n)
    total, main = 0.0, np.zeros(n)
    for code in range(2 ** n):
        y = [(code >> i) & 1 for i in range(n)]
        w = np.exp(sum(own[i] * y[i] for i in range(n)) + sum(m.pair[forest.kind[i], y[page.parent[i]], y[i]] for i in range(1, n)))
        total += w
        main += w * np.array(y)
    assert np.allclose(p, main / total)


def test_held_out_pages():
    m = html_extract.model()
    pages = labelled_pages.labelled(200, seed=77)
    truth = [html_extract.text_of(p, html_extract.labels_of(p) == 1) for p in map(html_extract.parse, pages)]
    assert sum(a == b for a, b in zip(m.texts(pages), truth, strict=True)) >= 185


def test_pages_keep_their_article(spark):
    import html
    rows = spark.read.parquet(f"{SMOKE}/pages.parquet").collect()
    got = {r["page_id"]: r for r in queries.QUERIES["op5_html_extraction"](spark, SMOKE).collect()}
    assert len(got) == len(rows)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", article)]
        want = " ".join(b for b in blocks if b)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def test_page_edges(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "<div><p>cut <b"), (4, "u", "<!-- open"), (5, "u", "<script>x"), (None, "u", "<p>" * 3000 + "deep"),
            (6, "u", "<article><h1>T</h1><p>a&amp;b  c<br>d</p><ul><li>One, two.<li>Three.</ul></article><p class='comment'>no"), (6, "u", "<a href='")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = html_extract.extract(df)
    assert got.count() == len(rows) and got.where("text IS NULL OR n_chars <> length(text)").count() == 0
    assert html_extract.extract(df.limit(0)).count() == 0
    assert [r["text"] for r in got.where("page_id = 6").collect() if r["text"]] == ["T a&b c d One, two. Three."]


# --- chat ------------------------------------------------------------------------

def test_chat_round_trip(spark):
    rng = random.Random(2)
    pieces = [*chat_format.CONTROLS, "\\", "\\\\", "<", "|", ">", "[", "\n", "ok", "é", "<|>", "</s", ">"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    for t in texts:
        e = chat_format.escape(t)
        assert chat_format.unescape(e) == t and not any(c in e for c in chat_format.CONTROLS)
    rows = [(n // 5, n % 5, rng.choice(["user", "assistant", "system", "assistant", "</s>"]), t) for n, t in enumerate(texts)]
    rows += [(1000, 0, "user", None), (1001, None, "assistant", "x"), (1001, 0, None, "y"), (None, 1, "user", "z"), (1002, 1, "assistant", "b"), (1002, 1, "assistant", "a"),
             (1002, 1, "assistant", "a")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, example int")
    ex = chat_format.examples(df).collect()
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.examples(df)).collect()}
    convs = {}
    for c, n, role, t in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        convs.setdefault(c, []).append((role or "", t or ""))
    assert got.keys() == convs.keys()
    for c, turns in convs.items():
        r, loss = got[c], "".join(t for role, t in turns if role == "assistant")
        assert (r["n_turns"], r["loss_chars"]) == (len(turns), len(loss))
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{t}\n" for role, t in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        mine = sorted((e for e in ex if e["conv_id"] == c), key=lambda e: e["example"])
        assert r["formatted_chars"] == sum(len(e["formatted"]) for e in mine)
        at = [n for n, (role, _) in enumerate(turns) if role == "assistant"]
        for e, n in zip(mine, at, strict=False):  # all preceding turns, and the reply as target
            assert chat_format.turns_of(e["formatted"]) == turns[:n + 1]
            assert chat_format.unescape(e["formatted"][e["loss_start"]:e["loss_end"]]) == turns[n][1]
        assert len(mine) == len(at) + (turns[-1][0] != "assistant") and all(e["loss_start"] is None for e in mine[len(at):])
    assert chat_format.examples(df.limit(0)).count() == 0


# --- toxicity ----------------------------------------------------------------------

def toxic_docs(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ra", "men", "to", "ku", "li", "ves", "no"]) for _ in range(rng.randint(1, 4)))
    stems = ["zgrumf", "blixor", "qwertak", "fnordel"]
    out = []
    for i in range(n):
        w = [word() for _ in range(rng.randint(3, 150))]
        y = int(rng.random() < 0.3)
        for _ in range(rng.randint(1, 3) if y else 0):
            s = rng.choice(stems)
            w.insert(rng.randint(0, len(w)), s + word()[:3])  # inflections; most of them never seen in training
        out.append((i, " ".join(w), y))
    return out


def test_toxicity_held_out(spark):
    rows = toxic_docs(900, 1)
    docs = spark.createDataFrame([(i, t, 1.0) for i, t, _ in rows] + [(5000, None, 1.0), (5001, "", 1.0), (None, "... !", 1.0), (3, rows[3][1], 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows] + [(None, 1, 1), (1, None, 1), (10 ** 9, 1, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.fit(docs, labels, sample=400)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) + 4 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    kept = toxicity.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not r["predicted"] for r in got)
    assert all(r["predicted"] == 0 for r in got if r["doc_id"] in (5000, 5001))
    none = toxicity.fit(docs, labels.where("toxic = 0"))
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_held_out_labels_are_never_read(spark):
    rows = toxic_docs(200, 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int")
    flip = F.when(toxicity.held_out("doc_id"), 1 - F.col("y")).otherwise(F.col("y"))
    a, b = (toxicity.fit(docs, docs.select("doc_id", c.alias("toxic")), sample=60) for c in (F.col("y"), flip))
    assert np.array_equal(a.weight, b.weight) and (a.bias, a.slope, a.shift) == (b.bias, b.slope, b.shift)


# --- mixing ------------------------------------------------------------------------

def filled(sizes, weights=mixing.WEIGHTS):
    """Targets by resharing the excess until none is above its limit."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, target, full = 1.5 * sum(sizes.values()), {}, set()
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        open_ = sum(w[s] for s in order if s not in full)
        target = {s: 2.0 * sizes[s] if s in full else rest * w[s] / open_ for s in order}
        above = {s for s in order if s not in full and target[s] >= 2 * sizes[s]}
        if not above:
            return target
        full |= above


def test_mix_reaches_targets(spark):
    rng = random.Random(8)
    names = ["src1", "src10", "src2", None, "ü", "Z", "empty"]
    rows = [(i, " ".join("w" for _ in range(rng.choice((0, 3, 30, 90)))), (s := rng.choice(names[:6] + ["src1"] * 4))) for i in range(1500)]
    rows += [(2000, None, "empty"), (2001, " \t\r\n", "empty"), (None, "a b", "src2"), (5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame([(i, t, s, "x") for i, t, s in rows], "doc_id long, text string, source string, shard string")
    args = dict(block_words=500, shard_words=6000)
    got = mixing.allot(df, **args).collect()
    assert len(got) == len(rows)
    size = {n: 0 for n in names}
    for _, t, s in rows:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    target = filled(size)
    taken = {n: 0 for n in names}
    source = {(i, len((t or "").split())): s for i, t, s in rows}
    for r in got:
        s = source[r["doc_id"], r["size"]]
        assert r["source_size"] == size[s] and abs(r["target"] - target[s]) < 1e-6 and len(r["places"]) <= 2
        assert len({p["copy"] for p in r["places"]}) == len(r["places"])
        taken[s] += r["size"] * len(r["places"])
    assert all(abs(taken[s] - target[s]) <= 90 for s in names)
    again = mixing.allot(df.repartition(13), **args).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["size"], str(r["places"]))
    assert sorted(map(key, got), key=repr) == sorted(map(key, again), key=repr)
    mixed = mixing.mix(df.withColumnRenamed("shard", "lang"), **args).collect()
    assert len(mixed) == sum(len(r["places"]) for r in got)
    shards = {}
    for r in mixed:
        shards[r["shard"]] = shards.get(r["shard"], 0) + len((r["text"] or "").split())
    assert len(shards) > 5 and max(shards.values()) < 2 * sum(shards.values()) / len(shards)
    assert mixing.allot(df.limit(0), **args).count() == 0


def test_splitting_tree_is_exact_and_hypergeometric(spark):
    quotas = [400, 37, 3, 0, 160]
    root = spark.createDataFrame([(quotas,)], "quotas array<bigint>")
    draws = []
    for seed in range(40):
        leaves = mixing.split_tree(root, 5, seed).collect()
        assert sorted(r["shard"] for r in leaves) == list(range(5))
        assert np.sum([r["quotas"] for r in leaves], 0).tolist() == quotas
        assert {sum(r["quotas"]) for r in leaves} == {120}
        draws += [r["quotas"][4] for r in leaves]
    # 120 of 600 drawn, 160 marked: mean 32, variance 120 * 4/15 * 11/15 * 480/599
    assert abs(np.mean(draws) - 32) < 1e-9 and 12 < np.var(draws) < 27
