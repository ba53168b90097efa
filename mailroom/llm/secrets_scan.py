"""Secret scan with corpus-wide ownership frequency.

``scan(docs)`` finds secrets in whole texts and returns one row for each row of
``docs``: doc_id, n_assign, n_access, n_hex (long), base_sha256, spans (string),
n_live, n_shared (long: found values that belong to few owners, or to many).

Base spans, leftmost and non-overlapping for each kind (offsets in code points of
the whole match, end exclusive): ``assign``, a named assignment whose value has 12
characters or more; ``access``, an access key id of 18 or more; ``hex``, a
lower-case hex run of 16 or more. Base spans always stay.

The method adds spans. *Candidates* are further credential-shaped values: tokens
with a known issuer's prefix, three-part signed tokens, private key headers, and
long runs that mix upper case, lower case and digits. Whether such a value is a
credential or something everyone copies from a manual, no single text can tell.
So the value of every base and candidate span is hashed, and the hashes are
counted over the whole corpus: distinct *repositories* and distinct *owners* that
hold it. A value held by at most ``few`` owners and ``few_repos`` repositories is
owner-specific, live-looking; one that more of them hold is a widely copied
example. Live-looking candidates become spans of kind ``live``; copied ones don't.

How it runs: one pass finds the spans (Python's ``re``, one text at a time); the
hashes, not the texts, go through two partial aggregates (distinct pairs first,
so a value copied into a third of all rows is one row for each owner after the
map side); the few classes are joined back with a salt, and each row's verdicts
are gathered by its number.

Defined cases: null texts count as empty; empty texts have no spans (digest of the
empty string); a null owner or repository counts as one of its own; repeated rows
each get their row, and count as one repository and owner; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import batched, ready, salt_of, salted, stored

FEW = 1
FEW_REPOS = 2

# Fixed values of the base scan: kind, pattern, least length of its group.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "live")

# Further candidates: issuer prefixes, signed tokens, key headers, mixed runs.
CANDIDATE = re.compile(
    r"gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{30,}|[sr]k_live_[A-Za-z0-9]{16,}"
    r"|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"
    r"|[A-Za-z0-9+/_-]{20,}={0,2}")
_ISSUED = re.compile(r"gh[pousr]_|xox[abprs]-|AIza|[sr]k_live_|eyJ|-----BEGIN")


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, value) of the base spans, in order."""
    out = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def _mixed(v: str) -> bool:
    return any(c.isupper() for c in v) and any(c.islower() for c in v) and sum(c.isdigit() for c in v) >= 3


def candidate_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Candidates that no base span overlaps."""
    starts = [b[0] for b in base]
    reach = list(itertools.accumulate((b[2] for b in base), max))  # furthest end so far
    out = []
    for m in CANDIDATE.finditer(text):
        if not (_ISSUED.match(m[0]) or _mixed(m[0])):
            continue
        before = bisect.bisect_left(starts, m.end())
        if not before or reach[before - 1] <= m.start():
            out.append((m.start(), 3, m.end(), m[0]))
    return out


_FOUND = pa.schema([("doc_id", pa.int64()), ("owner", pa.string()), ("repo", pa.string()), ("starts", pa.list_(pa.int64())),
                    ("kinds", pa.list_(pa.int32())), ("ends", pa.list_(pa.int64())), ("values", pa.list_(pa.string()))])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("doc_id", "owner", "repo")]
            for i, owner, repo, t in zip(*cols, b.column("text"), strict=True):
                text = t.as_py() or ""
                base = base_spans(text)
                spans = base + candidate_spans(text, base)
                yield (i, owner, repo, [s[0] for s in spans], [s[1] for s in spans], [s[2] for s in spans],
                       [hashlib.sha256(s[3].encode("utf-8", "surrogatepass")).hexdigest()[:32] for s in spans])
    yield from batched(rows(), _FOUND, 512)


def found(docs: DataFrame, owner, repo) -> DataFrame:
    """One row for each of ``docs``, with spans and hashes of their values, and
    ``row``, its number. Written once."""
    d = docs.select("doc_id", "text", owner.cast("string").alias("owner"), repo.cast("string").alias("repo"))
    rows = d.mapInArrow(_find, "doc_id long, owner string, repo string, starts array<long>, kinds array<int>, ends array<long>, "
                        "values array<string>")
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "secrets")


def ownership(rows: DataFrame) -> DataFrame:
    """(value, repos, owners): how many hold each value, null counting as one."""
    held = rows.select("owner", "repo", F.explode("values").alias("value")).distinct()
    owners = held.groupBy("value", "owner").agg(F.count("*").alias("repos"))
    return owners.groupBy("value").agg(F.sum("repos").alias("repos"), F.count("*").alias("owners"))


def scan(docs: DataFrame, owner=None, repo=None, few: int = FEW, few_repos: int = FEW_REPOS) -> DataFrame:
    """See the module's text. ``owner`` and ``repo``: columns of ``docs``, by
    default ``source``, and ``source`` with ``lang``."""
    ready(docs.sparkSession)
    owner = F.col("source") if owner is None else owner
    repo = F.concat_ws("/", "source", "lang") if repo is None else repo
    rows = found(docs, owner, repo)
    counts = ownership(rows).withColumn("live", (F.col("owners") <= few) & (F.col("repos") <= few_repos)).select("value", "live")
    each = rows.where(F.size("values") > 0).select("row", F.posexplode("values").alias("at", "value"))
    verdicts = (each.withColumn("_salt", salt_of("row", "at")).join(salted(counts), ["value", "_salt"])
                .groupBy("row").agg(F.collect_set(F.when(F.col("live"), F.col("at"))).alias("live"),
                                    F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_shared")))
    j = rows.join(verdicts, "row", "left")
    span = F.arrays_zip(F.col("starts").alias("s"), F.col("kinds").alias("k"), F.col("ends").alias("e"))
    kept = F.filter(span, lambda x, i: (x["k"] < 3) | F.coalesce(F.array_contains("live", i), F.lit(False)))
    names = F.array(*[F.lit(k) for k in KINDS])
    text = lambda spans: F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(
        ":", F.element_at(names, x["k"] + 1), x["s"], x["e"])), ",")
    base = F.filter(span, lambda x: x["k"] < 3)
    n = lambda k: F.size(F.filter("kinds", lambda x: x == k)).cast("long")
    return j.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(text(base), 256).alias("base_sha256"),
                    text(kept).alias("spans"), F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"),
                    F.coalesce("n_shared", F.lit(0)).cast("long").alias("n_shared"))
