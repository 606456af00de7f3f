"""Quality classification by positive-unlabelled learning.

Learned from are trusted positives (rows labelled 1) and unlabelled web text (any rows of the corpus); labels of
bad rows are not used. A logistic model over text statistics minimises the non-negative unbiased risk

    prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)])

with the logistic loss l, by full-batch Adam until it no longer falls, ten times on random shares of the rows, whose mean is the model; where the second term turns negative, its gradient is taken the other way
round. The class prior is estimated from the same two samples: the share of unlabelled rows above a threshold over the
share of positives above it is an upper bound of the prior for any threshold of any score. Every row is scored by a model that was
fitted on the other half (equal rows are in one half); each bound gets its standard error added, so that the least of many is not
the luckiest, and the smallest over thresholds that keep at least half of the positives is taken.

Statistics of a whole text: histograms of pairs of character classes, of punctuation marks and, hashed, of byte pairs
(square roots of frequencies), the share of distinct words, of distinct pairs of words and of words that repeat the last one, mean and deviation of word lengths, and its length.

Scale: one pass over the texts without a shuffle to score; the samples (``positives`` and ``unlabelled`` rows at most, by
the smallest hashes of doc_id) are turned into statistics on the executors before they are collected.

Defined results: null and empty texts have all statistics zero and are scored like any other. With no labelled
positive or no unlabelled row every score is 0.5. Repeated rows are scored each; further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import Prefix, mix, slabs, words

PAIRS, CLASSES, EXTRA = 256, 9, 9
#: Marks that are counted one by one.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
FEATURES = PAIRS + CLASSES * CLASSES + len(MARKS) + EXTRA


def _classes() -> np.ndarray:
    out = np.full(256, 8)
    for b in range(128):
        c = chr(b)
        out[b] = 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c == " " else 4 if c in "\n\r\t" else 5 if c in ".,;:?'\"-" else 6 if c == "!" else 7
    return out


CLASS = _classes()
_MARK = np.full(256, -1)
_MARK[np.frombuffer(MARKS.encode(), np.uint8)] = np.arange(len(MARKS))


def statistics(texts: list[str | None]) -> np.ndarray:
    """(texts, FEATURES) as float32."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    for a, b in slabs(texts, 2 << 20):
        parts = [np.frombuffer((t or "").encode("utf-8", "surrogatepass"), np.uint8) for t in texts[a:b]]
        n, size = b - a, np.array([len(p) for p in parts])
        raw = np.concatenate([*(x for p in parts for x in (p, np.array([10], np.uint8)))])
        base = np.cumsum(np.r_[0, size + 1])
        doc = np.repeat(np.arange(n), size + 1)[:-1]
        inner = np.flatnonzero(doc == np.repeat(np.arange(n), size + 1)[1:])
        inner = inner[inner < base[doc[inner]] + size[doc[inner]] - 1] if len(inner) else inner
        d, x, y = doc[inner], raw[inner], raw[inner + 1]
        pairs = np.maximum(1, size - 1)[:, None]
        hashed = (x.astype(np.uint32) * 31 + y.astype(np.uint32) * 97 + (x.astype(np.uint32) * y >> 5)) % PAIRS
        block = out[a:b]
        block[:, :PAIRS] = np.sqrt(np.bincount(d * PAIRS + hashed, minlength=n * PAIRS).reshape(n, PAIRS) / pairs)
        block[:, PAIRS : PAIRS + CLASSES**2] = np.sqrt(np.bincount(d * CLASSES**2 + CLASS[x] * CLASSES + CLASS[y], minlength=n * CLASSES**2).reshape(n, -1) / pairs)
        kind = _MARK[raw[:-1]]
        block[:, PAIRS + CLASSES**2 : -EXTRA] = np.sqrt(np.bincount(doc[kind >= 0] * len(MARKS) + kind[kind >= 0], minlength=n * len(MARKS)).reshape(n, -1) / np.maximum(1, size)[:, None])
        ws, we = words(raw)
        if not len(ws):
            continue
        own, h, length = np.searchsorted(base, ws, "right") - 1, Prefix(raw).slices(ws, we), (we - ws).astype(float)
        count = np.bincount(own, minlength=n)
        some = np.maximum(1, count)
        mean = np.bincount(own, length, n) / some
        two = mix(h[:-1] * np.uint64(3) + h[1:])[own[1:] == own[:-1]]
        own2 = own[1:][own[1:] == own[:-1]]
        extra = block[:, -EXTRA:]
        extra[:, 0] = _distinct(own, h, n) / some
        extra[:, 1] = _distinct(own2, two, n) / np.maximum(1, count - 1)
        extra[:, 2] = mean / 10
        extra[:, 3] = np.sqrt(np.maximum(0, np.bincount(own, length**2, n) / some - mean**2)) / 10
        extra[:, 4] = np.log1p(count) / 10
        extra[:, 5] = np.sqrt(np.bincount(doc[raw[:-1] == 10][: len(doc)], minlength=n)[:n] / some)
        extra[:, 6] = (count == 0) & (size > 0)
        again = (own[1:] == own[:-1]) & (h[1:] == h[:-1])
        extra[:, 7] = np.sqrt(np.bincount(own[1:][again], minlength=n) / some)
        extra[:, 8] = -np.log(np.maximum(extra[:, 0], 1e-3)) * (count > 0)
    return out


def _distinct(own: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct hashes of each owner."""
    return np.bincount((np.unique((h & ~np.uint64(0xFFFFF)) | own.astype(np.uint64)) & np.uint64(0xFFFFF)).astype(np.intp), minlength=n)[:n]


def fit(p: np.ndarray, u: np.ndarray, prior: float, rounds: int = 800, rate: float = 0.1, decay: float = 1e-3, tolerance: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative unbiased risk of positives p and unlabelled u."""
    p, u = p.astype(np.float32), u.astype(np.float32)
    w, b = np.zeros(p.shape[1], np.float32), np.float32(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w) + 1, np.float32), np.zeros(len(w) + 1, np.float32)
    sigmoid = lambda g: 1 / (1 + np.exp(-np.clip(g, -40, 40)))
    risks: list[float] = []
    for i in range(1, rounds + 1):
        gp, gu = p @ w + b, u @ w + b
        sp, su = sigmoid(gp), sigmoid(gu)
        rest = float(np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean())
        risks.append(prior * float(np.logaddexp(0, -gp).mean()) + max(0.0, rest) + 0.5 * decay * float(w @ w))
        if i % 50 == 0 and i > 150 and np.mean(risks[-100:-50]) - np.mean(risks[-50:]) < tolerance:
            break
        # d l(g) = s - 1, d l(-g) = s
        up, neg_p, neg_u = prior * (sp - 1) / len(p), -prior * sp / len(p), su / len(u)
        if rest >= 0:
            cp, cu = up + neg_p, neg_u
        else:
            cp, cu = -neg_p, -neg_u
        g = np.r_[p.T @ cp + u.T @ cu + decay * w, cp.sum() + cu.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (1 - i / (rounds + 1)) * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
        w, b = (w - step[:-1]).astype(np.float32), b - step[-1]
    return w.astype(float), float(b)


def _halves(x: np.ndarray) -> np.ndarray:
    """A half for each row; equal rows have the same."""
    return np.array([zlib.crc32(np.ascontiguousarray(r).tobytes()) & 1 for r in x])


def estimate_prior(p: np.ndarray, u: np.ndarray) -> float:
    """An estimate of the share of positives in u."""
    hp, hu = _halves(p), _halves(u)
    sp, su = np.zeros(len(p)), np.zeros(len(u))
    for k in (0, 1):
        if not (0 < (hp == k).sum() < len(p) and 0 < (hu == k).sum() < len(u)):
            return 0.5
        w, b = fit(p[hp != k], u[hu != k], 0.5)
        sp[hp == k], su[hu == k] = p[hp == k] @ w + b, u[hu == k] @ w + b
    best = 1.0
    for t in np.quantile(sp, np.linspace(0, 0.5, 51)):
        a, c = (su >= t).mean(), (sp >= t).mean()
        error = np.sqrt(a * (1 - a) / len(su) + (a / c) ** 2 * c * (1 - c) / len(sp)) / c
        best = min(best, a / c + error)
    return float(np.clip(best, 0.05, 0.98))


def fit_many(p: np.ndarray, u: np.ndarray, prior: float, fits: int = 10, share: float = 0.8, seed: int = 0) -> tuple[np.ndarray, float]:
    """The mean weights and bias of fits on random shares of the rows: a single fit on few positives depends on chance."""
    rng, found = np.random.default_rng(seed), []
    for _ in range(fits):
        some = [x[rng.permutation(len(x))[: max(2, int(share * len(x)))]] for x in (p, u)]
        found.append(fit(*some, prior))
    return np.mean([w for w, _ in found], axis=0), float(np.mean([b for _, b in found]))


class Model:
    def __init__(self, p: np.ndarray, u: np.ndarray):
        both = np.concatenate([p, u])
        self.mean, self.scale = both.mean(axis=0), both.std(axis=0) + 1e-2
        p, u = ((x - self.mean) / self.scale for x in (p, u))
        self.prior = estimate_prior(p, u)
        self.w, self.b = fit_many(p, u, self.prior)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        g = (statistics(texts) - self.mean) / self.scale @ self.w + self.b
        return 1 / (1 + np.exp(-np.clip(g, -40, 40)))


def _statistics(batches):
    for batch in batches:
        rows = statistics(batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r.tobytes() for r in rows], pa.binary())], ["doc_id", "stats"])


def _sample(docs: DataFrame, ids: DataFrame, most: int) -> np.ndarray:
    """Statistics of the rows of docs with the ``most`` smallest hashes of ids, one row for each of these ids."""
    picked = [r[0] for r in ids.filter(F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()]
    rows = docs.filter(F.col("doc_id").isin(picked)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    got = sorted(tuple(r) for r in rows.mapInArrow(_statistics, "doc_id long, stats binary").groupBy("doc_id").agg(F.min("stats").alias("stats")).collect())
    return np.array([np.frombuffer(s, np.float32) for _, s in got]).reshape(-1, FEATURES)


def _score(model: Model):
    def run(batches):
        for batch in batches:
            s = model(batch.column("text").to_pylist())
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(s, pa.float64())], [*keep, "score"])

    return run


def quality_scores(docs: DataFrame, corpus: DataFrame, positive_ids: DataFrame, positives: int = 2000, unlabelled: int = 4000) -> DataFrame:
    """doc_id and score of each row of docs. corpus: rows (doc_id, text) that may be learned from; positive_ids: doc_id of trusted ones."""
    p, u = _sample(corpus, positive_ids, positives), _sample(corpus, corpus, unlabelled)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if len(p) < 4 or len(u) < 4:
        return plain.select("doc_id", F.lit(0.5).alias("score"))
    return plain.mapInArrow(_score(Model(p, u)), "doc_id long, score double")


def held_out():
    """Whether crc32(doc_id as text) mod 4 is 2; a null doc_id is never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(True))


def op5(spark, sf_dir, threshold: float = 0.7):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out() & (F.col("quality") == 1)).select("doc_id")
    scored = quality_scores(docs, docs.filter(~held_out()), labels)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
