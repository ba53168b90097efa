"""Toxicity: subword-bag embeddings averaged into a linear softmax.

``fit(docs, labels)`` trains a ``Model`` and ``score(docs, model)`` gives every
document a score from 0 to 1 (higher: label 1 likelier).

Model
  A word (said several times in a row, it counts once) is a bag of features: itself and its character n-grams of 3 to 5
  between border marks, hashed into ``BUCKETS`` rows of an embedding table. A
  window of ``WINDOW`` words is the average of all its words' feature vectors,
  and a linear softmax over the two labels reads that average. Embeddings and
  softmax are trained jointly (AdaGrad, numpy). A misspelt or inflected word
  that was never seen shares most n-gram rows with the word it comes from.

  A few words make a long text toxic, and the average over a whole text would
  drown them. So the softmax is applied to every window of a text (all windows,
  stride 1, whole text) and the text's evidence is its highest window. Labels
  exist for whole texts only: training starts with every window of a text
  carrying the text's label, and in later rounds each toxic text keeps only its
  highest windows as toxic (multiple-instance learning). A logistic curve of
  the highest window, fitted on the labelled texts, turns it into the score.

Training reads at most ``SAMPLE`` labelled documents of each label (documented
bound, those with the smallest hash of doc_id among the labelled ones that are in
``docs``). Of a text beyond ``LONGEST`` characters it reads ``SLICES`` slices from all
over it, together that long, and of one that is not toxic at most ``WORDS_EACH``
words in windows chosen from all over it; scoring reads every word of every
document.

Scoring is linear: a word adds (sum of its rows' softmax weights, number of its
rows) to each window it is in, so a worker computes a word once and remembers it
(a bounded table) and windows are differences of running sums.

Defined cases: null and empty texts, and texts without a word, score as a text
with no evidence at all (the curve's lower end); a doc_id that labels name twice
is trained on once for each label row; without labelled rows of both labels the
score is 0.0; empty tables give an empty result; repeated rows score alike.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import ready
from .words import WORDS

BUCKETS = 1 << 16  # at most: rows are numbered in 16 bits
DIM = 12
WINDOW = 5
SAMPLE = 2500
LONGEST = 100_000
SLICES = 50
WORDS_EACH = 400
THRESHOLD = 0.3
LOT = 384
_GRAMS = (3, 4, 5)
_REMEMBER = 150_000
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def tokens_of(text: str | None) -> list[str]:
    """Lowercased words; a word said many times in a row counts once."""
    words = WORDS(text.lower()) if text else []
    return [w for i, w in enumerate(words) if i == 0 or w != words[i - 1]]


def subwords(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(features, offsets): the rows of each word, word after word."""
    text = "".join(f"\x02{w}\x03" for w in tokens)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([len(w) + 2 for w in tokens], np.int64)
    first = np.concatenate([[0], np.cumsum(size)])
    word = np.repeat(np.arange(len(tokens)), size)
    feats, owners = [], []
    # the whole word: a polynomial over its characters, summed per word
    place = np.arange(len(code)) - first[word]
    power = _powers(int(size.max(initial=1)))
    whole = np.add.reduceat(code * power[place], first[:-1]) if len(tokens) else np.zeros(0, np.uint64)
    feats.append(_bucket(whole, 0))
    owners.append(np.arange(len(tokens)))
    for n in _GRAMS:
        m = len(code) - n + 1
        if m <= 0:
            continue
        ok = word[:m] == word[n - 1:]
        h = code[:m].copy()
        for k in range(1, n):
            h = h * _MUL + code[k:k + m]
        feats.append(_bucket(h[ok], n))
        owners.append(word[:m][ok])
    f, o = np.concatenate(feats), np.concatenate(owners)
    order = np.argsort(o, kind="stable")
    return f[order], np.searchsorted(o[order], np.arange(len(tokens) + 1))


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _MUL)]))


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h + np.uint64(kind + 1)) * _MIX
    h ^= h >> np.uint64(31)
    h *= _MUL
    return (h >> np.uint64(40)).astype(np.int64) % BUCKETS


@dataclass
class Model:
    """Per-row softmax weights (label 1 minus label 0), bias, score curve."""

    weight: np.ndarray
    bias: float = 0.0
    slope: float = 0.0
    shift: float = -np.inf
    _known: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_known": {}}

    def _learn(self, tokens: set[str]) -> None:
        for s in range(0, len(new := sorted(tokens)), 20_000):
            part = new[s:s + 20_000]
            f, off = subwords(part)
            total = np.add.reduceat(self.weight[f], off[:-1])
            for w, t, n in zip(part, total.tolist(), np.diff(off).tolist(), strict=True):
                self._known[w] = (t, n)

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        """Highest window of each text; -inf without a word."""
        split = [tokens_of(t) for t in texts]
        out = np.full(len(texts), -np.inf)
        for i, tokens in enumerate(split):
            if not tokens:
                continue
            for s in range(0, len(tokens), 200_000):  # a stretch at a time, overlapping by a window
                part = tokens[s:s + 200_000 + WINDOW - 1]
                new = set(part).difference(self._known)
                if len(self._known) + len(new) > _REMEMBER:
                    self._known.clear()
                    new = set(part)
                self._learn(new)
                v = np.array([self._known[w] for w in part])
                out[i] = max(out[i], float(self._windows(v).max()))
        return out

    def _windows(self, v: np.ndarray) -> np.ndarray:
        c = np.vstack([np.zeros((1, 2)), np.cumsum(v, 0)])
        w = min(WINDOW, len(v))
        d = c[w:] - c[:-w]
        return d[:, 0] / d[:, 1] + self.bias

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not np.isfinite(self.shift):
            return np.zeros(len(texts))
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-(self.slope * self.evidence(texts) + self.shift)))


def train(texts: list[str | None], toxic: list[int], rounds: int = 4, steps: int = 700, seed: int = 7) -> Model:
    """Fit on whole labelled texts, held in memory (bounded by the caller)."""
    rng = np.random.default_rng(seed)
    y_doc = np.array(toxic, np.int64)
    if len(set(y_doc.tolist())) < 2:
        return Model(np.zeros(BUCKETS))
    # windows of WINDOW words, one after the other; of a text that is not toxic, a bounded choice
    vocabulary: dict[str, int] = {}
    ids, owner, size = [], [], []
    for d, t in enumerate(texts):
        words = tokens_of(t)
        begin = range(0, len(words), WINDOW)
        if y_doc[d] == 0 and len(begin) > WORDS_EACH // WINDOW:
            begin = np.sort(rng.choice(len(begin), WORDS_EACH // WINDOW, replace=False)) * WINDOW
        for b in begin:
            part = words[b:b + WINDOW]
            ids.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in part), np.int32, len(part)))
        owner.append(np.full(len(begin), d, np.int32))
        size.append(np.minimum(WINDOW, len(words) - np.asarray(begin, np.int64)))
    if not ids:
        return Model(np.zeros(BUCKETS))
    owner, size, flat = np.concatenate(owner), np.concatenate(size), np.concatenate(ids)
    start = np.concatenate([[0], np.cumsum(size)])
    del ids
    feats, count = [], []
    words = list(vocabulary)
    for s in range(0, len(words), 20_000):
        f, o = subwords(words[s:s + 20_000])
        feats.append(f.astype(np.uint16))
        count.append(np.diff(o))
    del vocabulary, words
    feats, count = np.concatenate(feats), np.concatenate(count)
    off = np.concatenate([[0], np.cumsum(count)])

    emb = rng.normal(0, 1 / DIM, (BUCKETS, DIM))
    soft = rng.normal(0, 0.1, DIM)
    bias = 0.0
    g_emb, g_soft, g_bias = np.full(BUCKETS, 1e-3), np.full(DIM, 1e-3), 1e-3
    target = y_doc[owner].astype(float)
    use = np.ones(len(owner), bool)

    def members(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Feature rows of windows w, and which of them each belongs to."""
        tok, own = _spread(start[w], size[w])
        tok = flat[tok]
        f, k = _spread(off[tok], count[tok])
        return feats[f], own[k]

    for r in range(rounds):
        lr = 0.4 if r == 0 else 0.25
        pool = np.nonzero(use)[0]
        lots = max(1, len(pool) // LOT)
        for _ in range(-(-steps // lots)):  # whole passes, ``steps`` lots at least
            # both labels carry the same total weight
            share = target[pool].mean()
            importance = np.where(target > 0, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6))
            for lot in np.array_split(rng.permutation(pool), lots):
                f, k = members(lot)
                n = np.bincount(k, minlength=len(lot))
                mean = np.zeros((len(lot), DIM))
                rows = emb[f]
                edge = np.concatenate([[0], np.cumsum(n)])[:-1]
                mean = np.add.reduceat(rows, edge) / n[:, None]
                p = 1 / (1 + np.exp(-(mean @ soft + bias)))
                g = (p - target[lot]) * importance[lot] / len(lot)
                # embeddings: every row of a window gets g / n of the softmax vector
                at, inv = np.unique(f, return_inverse=True)
                c = np.bincount(inv, weights=(g / n)[k])
                g_emb[at] += c * c * (soft @ soft)
                ds, db = g @ mean, g.sum()
                emb[at] -= (lr * c / np.sqrt(g_emb[at]))[:, None] * soft[None, :]
                g_soft += ds * ds
                soft = soft - lr * ds / np.sqrt(g_soft)
                g_bias += db * db
                bias -= lr * db / np.sqrt(g_bias)
        model = Model(emb @ soft, float(bias))
        total = np.add.reduceat(model.weight[feats], off[:-1])  # of each word
        z = np.add.reduceat(total[flat], start[:-1]) / np.add.reduceat(count[flat], start[:-1])
        # toxic texts keep their highest window, and others nearly as high
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, owner, z)
        spread = z.std() + 1e-9
        keep = (target > 0) & (z >= best[owner] - 0.5 * spread)
        use = (target == 0) | keep
    model.slope, model.shift = _curve(model.evidence(texts), y_doc)
    model._known.clear()
    return model


def _spread(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices first[i] .. first[i] + size[i] for every i, and i of each."""
    own = np.repeat(np.arange(len(size)), size)
    before = np.concatenate([[0], np.cumsum(size)])[:-1]
    return np.arange(len(own)) - before[own] + first[own], own


def _curve(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic curve of the highest window (Newton steps, slight ridge)."""
    ok = np.isfinite(z)
    x, y = z[ok], y[ok].astype(float)
    mid, wide = x.mean(), x.std() + 1e-9
    x = (x - mid) / wide
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * x + b)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - y) * x).sum() + 0.05 * a, (p - y).sum()])
        h = np.array([[(w * x * x).sum() + 0.05, (w * x).sum()], [(w * x).sum(), w.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    return float(max(a, 1e-6) / wide), float(b - max(a, 1e-6) * mid / wide)


def held_out(doc_id) -> object:
    """Rows whose crc32(doc_id as text) mod 4 is 2 are never trained on."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Train on at most ``sample`` labelled documents of each label, in one
    task: texts stay on the executors, and the driver gets the model's numbers."""
    ready(docs.sparkSession)
    usable = labels.where("doc_id is not null").where(~held_out("doc_id")).select("doc_id", "toxic")
    each = LONGEST // SLICES
    step = F.length("text") / F.lit(SLICES)
    slices = F.transform(F.sequence(F.lit(0), F.lit(SLICES - 1)), lambda i: F.substr("text", (i * step).cast("int") + 1, F.lit(each)))
    short = docs.select("doc_id", F.when(F.length("text") > LONGEST, F.array_join(slices, "\n")).otherwise(F.col("text")).alias("text"))
    there = docs.select("doc_id").distinct()
    picked = []
    for label in (0, 1):
        ids = usable.where(F.col("toxic") == label).join(there, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        # at most ``sample`` ids: a broadcast of bounded size; documents are not shuffled
        got = short.join(F.broadcast(ids), "doc_id").orderBy(F.xxhash64("doc_id", "text")).limit(sample)
        picked.append(got.select("doc_id", "text", "toxic"))
    row = picked[0].union(picked[1]).repartition(1).mapInArrow(_train_task, "weight binary, bias double, slope double, shift double").first()
    if row is None or not np.isfinite(row["shift"]):
        warnings.warn("toxicity: no labelled text of one label or of both, nothing was learnt", stacklevel=2)
    if row is None:
        return Model(np.zeros(BUCKETS))
    return Model(np.frombuffer(bytes(row["weight"]), np.float64), row["bias"], row["slope"], row["shift"])


def _train_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("toxic", "doc_id", "text")), strict=True)]
    rows.sort()  # the same order whichever way the rows came
    m = train([r[2] for r in rows], [r[0] for r in rows])
    yield pa.RecordBatch.from_pydict({"weight": [m.weight.astype(np.float64).tobytes()], "bias": [m.bias], "slope": [m.slope], "shift": [m.shift]})


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            for s in range(0, b.num_rows, 64):
                part = b.slice(s, 64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(m.scores(part.column("text").to_pylist()))], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double").select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs``, all columns, without the rows that score the threshold or more."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(held.value.scores(b.column("text").to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)
